"""Mosaics, resampling, overviews and reprojection of rasters given as cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, dense


def overlay(layers: list[DataFrame], *, value: str = "v") -> DataFrame:
    """Cells of several rasters on one grid; where more than one has a value the last layer's counts, NULL never does."""
    tagged = [d.select("row", "col", F.col(value), F.lit(k).alias("__order")) for k, d in enumerate(layers)]
    both = reduce(DataFrame.unionByName, tagged)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__order")))
    return both.groupBy("row", "col").agg(last.alias(value))


def reduce_max(layers: list[DataFrame], *, value: str = "v") -> DataFrame:
    """The largest value of each cell over several rasters."""
    both = reduce(DataFrame.unionByName, [d.select("row", "col", value) for d in layers])
    return both.groupBy("row", "col").agg(F.max(value).alias(value))


def downsample(cells: DataFrame, factor: int, *, value: str = "v", method: str = "mean") -> DataFrame:
    """Blocks of factor x factor cells: their mean, or for categories their mode (of equals the smallest)."""
    blocks = cells.select(F.expr(f"cast(row div {factor} AS int)").alias("row"), F.expr(f"cast(col div {factor} AS int)").alias("col"), F.col(value))
    if method == "mean":
        return blocks.groupBy("row", "col").agg(F.avg(value).alias(value))
    if method != "mode":
        raise ValueError("method is 'mean' or 'mode'")
    counts = blocks.where(F.col(value).isNotNull()).groupBy("row", "col", value).agg(F.count("*").alias("n"))
    top = counts.groupBy("row", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best"))
    return blocks.select("row", "col").distinct().join(top, ["row", "col"], "left").select("row", "col", F.col("best.v").alias(value))


def pyramid(cells: DataFrame, levels: tuple[int, ...] = (2, 4, 8, 16), *, value: str = "v") -> DataFrame:
    """Means at several block sizes: level, row, col, value. Cells are summed up per level before they are shuffled."""
    each = cells.select(F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"), "row", "col", value)
    each = each.select("level", F.expr("cast(row div level AS int)").alias("row"), F.expr("cast(col div level AS int)").alias("col"), value)
    return each.groupBy("level", "row", "col").agg(F.avg(value).alias(value))


def resample(
    cells: DataFrame,
    source: Grid,
    target: Grid,
    *,
    inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None,
    method: str = "bilinear",
    value: str = "v",
) -> DataFrame:
    """Values of ``target``'s cells from a raster on ``source``.

    ``inverse`` maps target to source coordinates where the grids differ in projection. Bilinear takes the four cells
    around each centre, weighted over those that have a value; nearest takes the cell that holds it. Each target cell
    asks for its source cells in an equi-join, so neither raster is ever held whole.
    """
    spark = cells.sparkSession
    grid = dense(spark.createDataFrame([], "row int, col int, __none int"), spark, target).drop("__none")
    x, y = target.centre(F.col("row"), F.col("col"))
    if inverse:
        x, y = inverse(x, y)
    if method == "nearest":
        r, c = source.cell(x, y)
        asked = grid.withColumns({"s_row": r, "s_col": c})
        found = asked.join(cells.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), F.col(value)), ["s_row", "s_col"], "left")
        return found.select("row", "col", value)
    if method != "bilinear":
        raise ValueError("method is 'bilinear' or 'nearest'")
    at = grid.withColumns({"fy": (y - source.f) / source.e - 0.5, "fx": (x - source.c) / source.a - 0.5})
    at = at.withColumns({"r0": F.floor("fy").cast("int"), "c0": F.floor("fx").cast("int")})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    part = lambda f, base, k: F.when(F.col(k) == 1, F.col(f) - F.col(base)).otherwise(1 - (F.col(f) - F.col(base)))
    asked = at.select("row", "col", "fy", "fx", "r0", "c0", corner).select(
        "row", "col", (F.col("r0") + F.col("o.a")).alias("s_row"), (F.col("c0") + F.col("o.b")).alias("s_col"),
        (part("fy", "r0", "o.a") * part("fx", "c0", "o.b")).alias("w"),
    ).where("w > 0")
    found = asked.join(cells.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), F.col(value).cast("double").alias("v")), ["s_row", "s_col"], "left")
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return found.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / total).alias(value))
