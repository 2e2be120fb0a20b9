"""Writers that do nothing when the result is there already, and GeoJSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exists(df: DataFrame, path: str) -> bool:
    """Whether a finished write is there: a file, or a folder that its job marked as whole."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    return files.exists(at) and (files.getFileStatus(at).isFile() or files.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def write(df: DataFrame, path: str, *, overwrite: bool = False, partition_by: tuple[str, ...] = (), fmt: str = "parquet", **options) -> bool:
    """Write unless a finished write is at the path and ``overwrite`` is not set; tells whether it wrote."""
    if not overwrite and exists(df, path):
        return False
    writer = df.write.format(fmt).mode("overwrite").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return True


def write_cells(cells: DataFrame, path: str, *, tile_size: int = 1000, **options) -> bool:
    """Raster cells partitioned and sorted by tile, so that windows read few row groups."""
    tiled = cells.withColumns({"tile_row": F.expr(f"cast(row div {tile_size} AS int)"), "tile_col": F.expr(f"cast(col div {tile_size} AS int)")})
    tiled = tiled.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col")
    return write(tiled, path, partition_by=("tile_row", "tile_col"), **options)


def feature_json(geom: str, properties: tuple[str, ...]):
    """A GeoJSON feature as text."""
    coordinates = F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry")))


def write_geojson(df: DataFrame, path: str, *, geom: str = "geom", properties: tuple[str, ...] = (), overwrite: bool = False) -> bool:
    """One feature per line (GeoJSON text sequence without separators), written by all tasks."""
    return write(df.select(feature_json(geom, properties).alias("value")), path, overwrite=overwrite, fmt="text")
