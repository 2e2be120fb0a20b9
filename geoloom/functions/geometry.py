"""Polygons as ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>> (polygons, rings, vertices; rings closed), without a geometry library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def edges(geom: Column | str) -> Column:
    """All edges of all rings: what the predicates below read. Even-odd counting over them handles holes and parts."""
    rings = F.flatten(geom)
    ring = lambda r: F.transform(
        F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))),
        lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(r, i + 1)["x"].alias("x2"), F.get(r, i + 1)["y"].alias("y2")),
    )
    return F.flatten(F.transform(rings, ring))


def crosses(e: Column, x: Column, y: Column) -> Column:
    """The ray from (x, y) to the right meets the edge."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])


def on_edge(e: Column, x: Column, y: Column) -> Column:
    """(x, y) lies on the edge itself."""
    turn = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
    inside = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return (turn == 0) & inside


def within(all_edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside: a point on the boundary is not within."""
    odd = F.size(F.filter(all_edges, lambda e: crosses(e, x, y))) % 2 == 1
    return odd & ~F.exists(all_edges, lambda e: on_edge(e, x, y))


def intersects(all_edges: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    odd = F.size(F.filter(all_edges, lambda e: crosses(e, x, y))) % 2 == 1
    return odd | F.exists(all_edges, lambda e: on_edge(e, x, y))


def area(geom: Column | str) -> Column:
    """Area in the square of the map unit: each polygon's first ring less its other rings."""
    zero = F.lit(0.0)

    def ring(r: Column) -> Column:
        step = lambda s, i: s + F.get(r, i)["x"] * F.get(r, i + 1)["y"] - F.get(r, i + 1)["x"] * F.get(r, i)["y"]
        return F.abs(F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), zero, step)) / 2

    def polygon(p: Column) -> Column:
        return F.aggregate(p, zero, lambda s, r: s - ring(r)) + 2 * ring(F.get(p, F.lit(0)))

    return F.aggregate(F.col(geom) if isinstance(geom, str) else geom, zero, lambda s, p: s + polygon(p))


def area_km2(geom: Column | str) -> Column:
    return area(geom) / 1e6


def bounds(geom: Column | str) -> dict[str, Column]:
    """minx, miny, maxx, maxy."""
    points = F.flatten(F.flatten(geom))
    pick = lambda name: F.transform(points, lambda p: p[name])
    return {"minx": F.array_min(pick("x")), "miny": F.array_min(pick("y")), "maxx": F.array_max(pick("x")), "maxy": F.array_max(pick("y"))}


def buffered_bounds(geom: Column | str, by: float) -> dict[str, Column]:
    """Bounds widened by ``by`` and rounded outwards to whole units."""
    b = bounds(geom)
    return {"minx": F.floor(b["minx"] - by), "miny": F.floor(b["miny"] - by), "maxx": F.ceil(b["maxx"] + by), "maxy": F.ceil(b["maxy"] + by)}


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def is_usable(geom: Column | str) -> Column:
    """Not empty, every ring of at least four vertices and closed, and an area above zero."""
    g = F.col(geom) if isinstance(geom, str) else geom
    closed = F.forall(F.flatten(g), lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    return F.coalesce((F.size(g) > 0) & closed & F.when(closed, area(g) > 0), F.lit(False))


def box_hits_edge(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The edge meets the box, by the Liang-Barsky interval of its parameter."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

    def span(d: Column, at: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (low - at) / F.when(d != 0, d), (high - at) / F.when(d != 0, d)
        flat = F.when(at.between(low, high), F.lit(0.0)).otherwise(F.lit(2.0))
        return F.coalesce(F.least(a, b), flat), F.coalesce(F.greatest(a, b), F.lit(1.0))

    x_in, x_out = span(dx, e["x1"], minx, maxx)
    y_in, y_out = span(dy, e["y1"], miny, maxy)
    return F.greatest(x_in, y_in, F.lit(0.0)) <= F.least(x_out, y_out, F.lit(1.0))
