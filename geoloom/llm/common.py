"""Shared helpers: seeded hashing, input checks, checked broadcasts; scratch tables are the core's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, release, shared_dir

__all__ = ["SPACE", "Scratch", "need", "release", "shared_dir", "small_side", "unit_hash"]

#: ASCII white space of the text contracts, as a Java and Python regular expression class body.
SPACE = r"\x20\x09-\x0D"


def unit_hash(*cols: Column | str, seed: int) -> Column:
    """A reproducible number in [0, 1) from the values of a row."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def small_side(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A written table, marked for broadcast if its rows take at most ``most`` bytes in memory; else left to a shuffled join.

    Rows are counted; strings, binaries and arrays are measured. Before a broadcast of some size the driver frees what
    earlier ones left, so that dead tables and buffers don't add up there.
    """
    wide = F.lit(16 + 8 * len(df.columns))
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind == "array":
            wide = wide + 8 + F.coalesce(F.size(field.name), F.lit(0)) * 8
        elif kind in ("string", "binary"):
            wide = wide + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("map", "struct"):
            return df
    size = df.agg(F.sum(wide)).first()[0] or 0
    if size > most:
        return df
    if size > most >> 4:
        release(df.sparkSession)
    return F.broadcast(df)
