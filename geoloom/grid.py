"""Regular grids: the affine transform between cells and map coordinates, lattices, tiles.

A raster is a DataFrame of cells (row, col, and value columns), nodata being NULL. Grids are compared before rasters are
combined cell by cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """x = c + col * a, y = f + row * e at a cell's corner; e is negative where rows run southwards."""

    a: float
    c: float
    e: float
    f: float
    width: int
    height: int
    crs: str = ""

    def corner(self, row: Column, col: Column) -> tuple[Column, Column]:
        """Map coordinates of a cell's corner."""
        return F.lit(self.c) + col * F.lit(self.a), F.lit(self.f) + row * F.lit(self.e)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        """Map coordinates of a cell's centre."""
        return F.lit(self.c) + (col + 0.5) * F.lit(self.a), F.lit(self.f) + (row + 0.5) * F.lit(self.e)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of the cell that holds a point."""
        return F.floor((y - self.f) / self.e).cast("int"), F.floor((x - self.c) / self.a).cast("int")

    def nearest_corner(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column rounded half to even, for points given at cell corners."""
        return F.bround((y - self.f) / self.e).cast("int"), F.bround((x - self.c) / self.a).cast("int")

    def same(self, other: Grid) -> None:
        if self != other:
            raise ValueError(f"rasters lie on different grids: {self} and {other}")

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)


def dense(cells: DataFrame, spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells of the grid, NULL where ``cells`` has no row: what windowed reads beyond the edge and focal steps need."""
    lattice = spark.range(grid.height * grid.width).select(
        F.expr(f"cast(id div {grid.width} AS int)").alias("row"), F.expr(f"cast(id % {grid.width} AS int)").alias("col")
    )
    return lattice.join(cells, ["row", "col"], "left")


def window(cells: DataFrame, row_off: int, col_off: int, height: int, width: int, *, fill: bool = False) -> DataFrame:
    """The cells of a window; on files sorted by tile the comparison prunes row groups.

    With ``fill`` every place of the window has a row, NULL where there is no cell: beyond the raster's edge too.
    """
    found = cells.where(F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1))
    if not fill:
        return found
    places = cells.sparkSession.range(height * width).selectExpr(f"CAST(id div {width} + ({row_off}) AS int) AS row", f"CAST(id % {width} + ({col_off}) AS int) AS col")
    return places.join(found, ["row", "col"], "left")


def tile_grid(spark: SparkSession, grid: Grid, tile_size: int = 5000, overlap: float = 0.0) -> DataFrame:
    """Square tiles that cover the grid, possibly beyond its edges, with their extents with and without overlap.

    ``overlap`` is in map units. Columns: tile_row, tile_col, core_bbox and ovlp_bbox (x, y, width, height in cells),
    crop_x_offset, crop_y_offset, and the core's minx, miny, maxx, maxy.
    """
    halo = int(round(overlap / abs(grid.a)))
    down, across = math.ceil(grid.height / tile_size), math.ceil(grid.width / tile_size)
    tiles = spark.range(down * across).select(
        F.expr(f"cast(id div {across} AS int)").alias("tile_row"), F.expr(f"cast(id % {across} AS int)").alias("tile_col")
    )
    x0, y0 = F.col("tile_col") * tile_size, F.col("tile_row") * tile_size
    minx, maxy = grid.corner(y0, x0)
    maxx, miny = grid.corner(y0 + tile_size, x0 + tile_size)
    return tiles.select(
        "tile_row",
        "tile_col",
        F.array(x0, y0, F.lit(tile_size), F.lit(tile_size)).alias("core_bbox"),
        F.array(x0 - halo, y0 - halo, F.lit(tile_size + 2 * halo), F.lit(tile_size + 2 * halo)).alias("ovlp_bbox"),
        F.lit(halo).alias("crop_x_offset"),
        F.lit(halo).alias("crop_y_offset"),
        minx.alias("minx"),
        miny.alias("miny"),
        maxx.alias("maxx"),
        maxy.alias("maxy"),
    )


def with_tile(cells: DataFrame, tile_size: int) -> DataFrame:
    """Add the tile (tile_row, tile_col) whose half-open core holds each cell."""
    return cells.withColumns(
        {"tile_row": F.floor(F.col("row") / tile_size).cast("int"), "tile_col": F.floor(F.col("col") / tile_size).cast("int")}
    )


def with_halo(cells: DataFrame, tile_size: int, halo: int, grid: Grid) -> DataFrame:
    """Each cell once for every tile whose extent with overlap holds it (tile_row, tile_col, in_core)."""
    down, across = math.ceil(grid.height / tile_size), math.ceil(grid.width / tile_size)

    def tiles(at: Column, most: int) -> Column:
        low = F.greatest(F.floor((at - halo) / tile_size), F.lit(0))
        high = F.least(F.floor((at + halo) / tile_size), F.lit(most - 1))
        return F.sequence(low.cast("int"), high.cast("int"))

    out = cells.withColumn("tile_row", F.explode(tiles(F.col("row"), down))).withColumn("tile_col", F.explode(tiles(F.col("col"), across)))
    core = (F.floor(F.col("row") / tile_size) == F.col("tile_row")) & (F.floor(F.col("col") / tile_size) == F.col("tile_col"))
    return out.withColumn("in_core", core)


def crop_core(tiled: DataFrame, tile_size: int) -> DataFrame:
    """Drop the overlap: keep the cells that lie in their tile's core."""
    home = (F.floor(F.col("row") / tile_size) == F.col("tile_row")) & (F.floor(F.col("col") / tile_size) == F.col("tile_col"))
    return tiled.where(home)


def tiles_touched(points: DataFrame, grid: Grid, tile_size: int) -> DataFrame:
    """Distinct tiles that a point lies in or on the edge of: a point on a shared edge touches both sides."""
    x, y = (F.col("x") - grid.c) / grid.a / tile_size, (F.col("y") - grid.f) / grid.e / tile_size

    def both(v: Column) -> Column:
        return F.array_distinct(F.array(F.floor(v), F.ceil(v) - 1)).cast("array<int>")

    down, across = math.ceil(grid.height / tile_size), math.ceil(grid.width / tile_size)
    found = points.select(F.explode(both(y)).alias("tile_row"), x.alias("vx")).select("tile_row", F.explode(both(F.col("vx"))).alias("tile_col"))
    return found.where(F.col("tile_row").between(0, down - 1) & F.col("tile_col").between(0, across - 1)).distinct()
