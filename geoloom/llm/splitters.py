"""Sampled splitters: size-weighted key samples, quantile boundaries, and the range that a key falls into."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

#: (group key, row id); an id of None sorts first, so (key, None) is where a group begins.
Splitter = tuple[str, int | None]


def _order(s: Splitter) -> tuple:
    return s[0], s[1] is not None, s[1] or 0


def draw(rows: DataFrame, key: str, row_id: str, weight: str, per_unit: float, seed: int) -> list[tuple[Splitter, float]]:
    """Sampled keys with the weight that each stands for.

    A row is taken with probability min(1, weight * per_unit), decided by a hash of the row: the expected number is at
    most total weight * per_unit, which the caller bounds, and a repeated run draws the same keys.
    """
    chance = F.col(weight) * F.lit(per_unit)
    taken = rows.where(unit_hash(key, row_id, seed=seed) < chance).select(key, row_id, weight).collect()
    return [((r[0], r[1]), max(float(r[2]), 1 / per_unit)) for r in taken]


def quantiles(sample: list[tuple[Splitter, float]], ranges: int) -> list[Splitter]:
    """Boundaries of about equal weight. A group of equal keys stays in one range unless it spans several."""
    if not sample or ranges < 2:
        return []
    sample = sorted(sample, key=lambda x: _order(x[0]))
    upto = list(accumulate(w for _, w in sample))
    cuts = [sample[min(bisect_right(upto, upto[-1] * i / ranges), len(sample) - 1)][0] for i in range(1, ranges)]
    return tidy(cuts)


def tidy(cuts: list[Splitter]) -> list[Splitter]:
    """Sorted and distinct; a key that occurs once cuts before its group, one that occurs again subdivides it too."""
    cuts = sorted(set(cuts), key=_order)
    times = Counter(k for k, _ in cuts)
    whole = {(k, None) for k in times}
    return sorted(whole | {c for c in cuts if times[c[0]] > 1}, key=_order)


def range_of(cuts: list[Splitter], key: Column, row_id: Column) -> Column:
    """Number of boundaries at or below (key, row_id): a binary search over one literal array."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"k": k, "i": i} for k, i in cuts])), "array<struct<k:string,i:bigint>>")
    probe = F.struct(key.alias("k"), row_id.cast("bigint").alias("i"))
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])

    def step(low: Column, jump: Column) -> Column:
        return F.when(F.get(table, low + jump - 1) <= probe, low + jump).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)
