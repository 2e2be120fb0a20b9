"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, work: Scratch, *, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) that isn't the smallest of its component.

    Each step points nodes at smaller ones: large-star replaces an edge's lower end by that end's smallest neighbour,
    small-star links a node's lower neighbours to the smallest of them. The edges end as stars around the smallest node
    of each component after O(log^2 n) rounds. Minima are aggregated before they are shuffled, and the edges meet them
    in a join that adaptive execution can split, so that a hub's edges never have to lie in one task. Each round is
    written to the shared folder, which cuts the lineage. Self-loops and nulls are dropped; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = work.table(pairs, "star0")
    mark = _mark(now)
    for k in range(1, rounds + 1):
        if not mark[0]:
            break
        least = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        large = now.join(least, now["lo"] == least["node"], "left").select("hi", F.coalesce("low", "lo").alias("lo")).distinct()
        large = work.table(large, f"large{k}")
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        joined = large.join(least, large["hi"] == least["node"]).select("hi", "lo", "low")
        small = joined.select(F.explode(F.array(F.struct("hi", F.col("low").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")))).alias("e"))
        after = work.table(small.where("e.hi <> e.lo").select("e.hi", "e.lo").distinct(), f"star{k}")
        work.drop(f"large{k}")
        work.drop(f"star{k - 1}")
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest: equal marks mean that a round changed nothing."""
    found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi", F.lit(7)))).first()
    return found[0], found[1], found[2]
