"""Plans made of several operators, and the queries of the registry."""
