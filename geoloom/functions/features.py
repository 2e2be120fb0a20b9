"""Derived features of observation points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def floored_ratio(a: Column, b: Column, floor: float = 30.0) -> Column:
    """a / max(b, floor); NULL where either is NULL (a plain ``greatest`` would skip a NULL b)."""
    return F.when(b.isNotNull(), a / F.greatest(b, F.lit(floor)))


def derived(point: tuple[str, str, str], stream: tuple[str, str, str], ridge: tuple[str, str, str], pixel: float = 30.0) -> dict[str, Column]:
    """dist_stream, dist_top, ratio_dist, alt_stream, alt_top and ratio_stream from (x, y, z) column names."""
    p, s, r = ([F.col(c) for c in names] for names in (point, stream, ridge))
    ds, dt = distance(p[0], p[1], s[0], s[1]), distance(p[0], p[1], r[0], r[1])
    up = p[2] - s[2]
    return {
        "dist_stream": ds,
        "dist_top": dt,
        "ratio_dist": floored_ratio(ds, dt, pixel),
        "alt_stream": up,
        "alt_top": r[2] - p[2],
        "ratio_stream": floored_ratio(up, ds, pixel),
    }


def prototype_ratios(z: Column, zs: Column, zr: Column, ds: Column, dr: Column, pixel: float = 30.0) -> dict[str, Column]:
    """The earlier ratios: a pixel is added to distances, and 0.1 to the difference of altitudes."""
    ds, dr = ds + pixel, dr + pixel
    return {"ratio_alt": (z - zs) / (zr - z + 0.1), "ratio_dist": ds / dr, "ratio_stream": (z - zs) / ds, "ratio_top": (zr - z) / dr}


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Value within limits; NULL stays NULL."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """Value by a small lookup table; values that aren't in it stay."""
    if not mapping:
        return value
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), value)
