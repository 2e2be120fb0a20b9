"""Observations: cleaning, exclusion lists, unions, enrichment with basins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geometry
from .spatial import points_within

POSITIONS = ("ID", "LON", "LAT", "DATE", "NS")


def cleaned(raw: DataFrame, *, country: str | None = None, strict: bool = True) -> DataFrame:
    """Five columns renamed by position, ids as text, dates normalised, rows with any NULL dropped."""
    if len(raw.columns) != len(POSITIONS):
        raise ValueError(f"expected {len(POSITIONS)} columns, found {len(raw.columns)}")
    out = raw.toDF(*POSITIONS)
    out = out.select(
        F.col("ID").cast("string").alias("ID"),
        F.col("LON").cast("double").alias("LON"),
        F.col("LAT").cast("double").alias("LAT"),
        dates.normalize_date(F.col("DATE").cast("string"), strict=strict).alias("DATE"),
        F.col("NS").cast("double").alias("NS"),
    ).na.drop(how="any")
    return out.withColumn("country", F.lit(country)) if country else out


def union_tagged(parts: dict[str, DataFrame], tag: str = "country") -> DataFrame:
    """Rows of all parts by column name, each with its part's name; columns that a part lacks are NULL."""
    tagged = [d.withColumn(tag, F.lit(name)) for name, d in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def without_listed(rows: DataFrame, listed: DataFrame, *, group: str, key: str, mode: str = "pairs") -> DataFrame:
    """Rows that aren't on an exclusion list (group, key).

    ``pairs`` drops rows whose group and key are listed together; ``cross`` drops those whose group is listed and whose
    key is listed, with whichever group.
    """
    if mode == "pairs":
        return rows.join(listed.select(group, key).distinct(), [group, key], "left_anti")
    if mode != "cross":
        raise ValueError("mode is 'pairs' or 'cross'")
    groups = listed.select(F.col(group).alias("__g")).distinct()
    keys = listed.select(F.col(key).alias("__k")).distinct()
    hit = rows.join(groups, rows[group] == F.col("__g"), "left").join(keys, rows[key] == F.col("__k"), "left")
    return hit.where("__g IS NULL OR __k IS NULL").drop("__g", "__k")


def enriched(points: DataFrame, basins: DataFrame, *, keep: tuple[str, ...], size: float, point_key: str = "ID", period: str = "fixed") -> DataFrame:
    """Points with the columns of their basin, its area, the recharge period and the first day of the climate period.

    Points outside every basin keep NULLs. ``period`` is 'fixed' (60 days) or 'by_area'.
    """
    shapes = basins.withColumn("basin_area_km2", geometry.area_km2("geom"))
    out = points_within(points, shapes, point_key=point_key, polygon_columns=(*keep, "basin_area_km2"), size=size)
    start = dates.period_start("DATE", period=period, area_km2="basin_area_km2")
    return out.withColumns({"climdata_period_days": dates.recharge_days("basin_area_km2"), "climdata_date_start": start})


def in_years(rows: DataFrame, *, start: str = "climdata_date_start", date: str = "DATE", after: int = 2002, before: int = 2025) -> DataFrame:
    """Rows whose period starts after a year and whose date lies before another."""
    return rows.where((F.year(start) > after) & (F.year(date) < before))


def basins_with_points(basins: DataFrame, points: DataFrame, *, key: str) -> DataFrame:
    return basins.join(points.select(key).distinct(), key, "left_semi")


def aligned(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """Columns of both by key, rows with any NULL dropped."""
    return left.join(right, key, "full_outer").na.drop(how="any")


def not_done(wanted: DataFrame, done: DataFrame, *, key: str) -> DataFrame:
    """Work that has no result yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
