"""Daily series: calendars, intervals, zonal means, window means, statistics over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row per day, both ends included."""
    return spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS date")


def on_calendar(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Every day of the calendar with the columns of ``days``, NULL where there are none."""
    return spine.join(days, "date", "left")


def expand_intervals(catalog: DataFrame, *, start: str = "date_start", end: str = "date_end", value: str = "file") -> DataFrame:
    """(date, value): each day of the intervals, both ends included; where they overlap the later start counts."""
    days = catalog.select(F.explode(F.sequence(start, end)).alias("date"), start, value)
    return days.groupBy("date").agg(F.max_by(value, F.struct(start, value)).alias(value))


def tiles_wide(catalog: DataFrame, tiles: list[str]) -> DataFrame:
    """A row per interval with a column for each tile's file, and ntiles, how many there are."""
    wide = catalog.groupBy("date_start", "date_end").pivot("tile", tiles).agg(F.min("file"))
    present = [F.when(F.col(f"`{t}`").isNotNull(), 1).otherwise(0) for t in tiles]
    return wide.withColumn("ntiles", sum(present[1:], present[0]))


def zonal_mean(cells: DataFrame, zones: DataFrame, *, value: str = "v") -> DataFrame:
    """(zone_id, mean, n): mean of the cells with a value; a zone without any has NULL."""
    return zones.join(cells, ["row", "col"], "left").groupBy("zone_id").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def zonal_daily_means(stack: DataFrame, zones: DataFrame, *, value: str = "v", scale: float = 1.0) -> DataFrame:
    """(date, zone_id, value) from cells by day. Means are taken per image before any spreading to days."""
    return stack.join(zones, ["row", "col"]).groupBy("date", "zone_id").agg((F.avg(value) * scale).alias("value"))


def wide_series(series: DataFrame, zones: list) -> DataFrame:
    """A row per date with a column per zone."""
    return series.groupBy("date").pivot("zone_id", zones).agg(F.first("value"))


def long_series(wide: DataFrame, zones: list[str]) -> DataFrame:
    """The reverse of ``wide_series``: (date, zone_id, value)."""
    return wide.unpivot("date", zones, "zone_id", "value")


def trailing_means(points: DataFrame, daily: DataFrame, *, point_key: str, start: str, end: str, zone: str = "zone_id") -> DataFrame:
    """(key, mean, n_days) of a daily series over each point's days from ``start`` to ``end``, both included.

    Running sums per zone are taken once; a point then needs the sums at two dates, found as the last rows at or before
    them. The work grows with points and days, not with their product, and days without a row or value don't count.
    Points with a NULL zone or date, or without any day, get NULL and 0.
    """
    w = Window.partitionBy(zone).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = daily.select(zone, "date", F.sum("value").over(w).alias("s"), F.count("value").over(w).alias("n"))
    asks = points.select(point_key, zone, F.explode(F.array(F.struct(F.date_sub(start, 1).alias("date"), F.lit(-1).alias("sign")), F.struct(F.col(end).alias("date"), F.lit(1).alias("sign")))).alias("a"))
    asks = asks.select(point_key, zone, "a.date", "a.sign", F.lit(None).cast("double").alias("s"), F.lit(None).cast("bigint").alias("n"))
    both = asks.unionByName(running.select(F.lit(None).cast(points.schema[point_key].dataType).alias(point_key), zone, "date", F.lit(0).alias("sign"), "s", "n"))
    upto = Window.partitionBy(zone).orderBy("date", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"fs": F.last("s", ignorenulls=True).over(upto), "fn": F.last("n", ignorenulls=True).over(upto)}).where("sign <> 0")
    total = found.groupBy(point_key).agg(F.sum(F.col("sign") * F.coalesce("fs", F.lit(0.0))).alias("s"), F.sum(F.col("sign") * F.coalesce("fn", F.lit(0))).alias("n"))
    return total.select(point_key, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), F.col("n").alias("n_days"))


def cell_statistics(stack: DataFrame, *, by: tuple[str, ...] = ("row", "col"), value: str = "v") -> DataFrame:
    """min, max, mean, std (population), sum and q10, q25, q50, q75, q90 over time, without the NULLs."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    stats = stack.groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sum(value).alias("sum"), q.alias("q")
    )
    return stats.withColumns({name: F.get("q", F.lit(k)) for k, name in enumerate(("q10", "q25", "q50", "q75", "q90"))}).drop("q")


def collected(series: DataFrame, *, key: str = "zone_id") -> DataFrame:
    """Each key's series in one column, an array of (date, value) in order of date."""
    return series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("series"))


def decade_histogram(dates: DataFrame, *, date: str = "date", first: int = 1950, last: int = 2020) -> DataFrame:
    """(decade, n) of the years from ``first`` to ``last``; the last bin also holds the year ``last`` itself."""
    year = F.year(date)
    decade = F.least(F.floor(year / 10) * 10, F.lit(last - 10)).cast("int")
    return dates.where(year.between(first, last)).groupBy(decade.alias("decade")).agg(F.count("*").alias("n"))
