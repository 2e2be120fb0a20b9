"""Readers: tables, GeoJSON, zipped elevation tiles, gridded series, file listings."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import GEOMETRY

OBSERVATIONS = "ID string, LON double, LAT double, DATE string, NS double"


def csv(spark: SparkSession, path: str, schema: str, *, header: bool = True, **options) -> DataFrame:
    """CSV with a given schema: nothing is inferred, so the file is read once."""
    return spark.read.csv(path, schema=schema, header=header, **options)


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet of observations, read on the driver (it needs an Excel engine for pandas) with columns by position."""
    frame = pd.read_excel(path, sheet_name=sheet, dtype={0: str, 3: str})
    return spark.createDataFrame(frame.iloc[:, :5].set_axis(["ID", "LON", "LAT", "DATE", "NS"], axis=1), OBSERVATIONS)


def geojson(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Features with the given properties (name -> type) and geom; Polygon becomes a MultiPolygon of one."""
    fields = ",".join(f"`{k}`:{v}" for k, v in properties.items())
    base = f"type string, features array<struct<properties:struct<{fields}>, geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(base).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    nested = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).when(F.col("f.geometry.type") == "Polygon", one)
    point = lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))
    geom = F.transform(nested, lambda p: F.transform(p, lambda r: F.transform(r, point))).cast(GEOMETRY)
    return rows.select(*[F.col(f"f.properties.`{k}`").alias(k) for k in properties], geom.alias("geom"))


def listing(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, modified, length) of files by pattern; a folder that doesn't exist gives none. Contents aren't read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, modified timestamp, length bigint")
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def elevation_zips(spark: SparkSession, path: str, *, with_water: bool = False, keep_errors: bool = False) -> DataFrame:
    """Cells of zipped elevation tiles: file, row, col, v, and water where asked for.

    A tile is a square of big-endian 16-bit integers in a member ending in .hgt, -32768 being nodata; a member ending in
    .swb holds a byte of water mask per cell and is needed only ``with_water``. Each file is one row of the reader, so
    files are read in parallel; cells leave in bands of rows. A file that can't be read raises; with ``keep_errors`` it
    gives one row with the message in ``error`` and no cell, and the other files' cells have a NULL there.
    """

    def bands(content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            member = lambda end: next((n for n in z.namelist() if n.lower().endswith(end)), None)
            height = member(".hgt")
            water = member(".swb") if with_water else None
            if height is None or with_water and water is None:
                raise ValueError("lacks an elevation or water member")
            v = np.frombuffer(z.read(height), ">i2")
            side = int(round(len(v) ** 0.5))
            wet = np.frombuffer(z.read(water), np.uint8) if with_water else None
            if side * side != len(v) or wet is not None and len(wet) != len(v):
                raise ValueError("a member isn't a square of cells")
        deep = max(1, 250_000 // max(1, side))
        for top in range(0, side, deep):
            rows = np.arange(top, min(top + deep, side))
            at = slice(rows[0] * side, (rows[-1] + 1) * side)
            band = {"row": np.repeat(rows, side), "col": np.tile(np.arange(side), len(rows)), "v": v[at].astype(float)}
            yield band | ({"water": wet[at].astype(int)} if with_water else {})

    fields = ["row int", "col int", "v double", *(["water int"] if with_water else [])]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for band in bands(content):
                        yield pd.DataFrame({"file": name} | band | ({"error": None} if keep_errors else {}))
                except (ValueError, EOFError, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as wrong:
                    if not keep_errors:
                        raise ValueError(f"{name}: {wrong}") from wrong
                    nothing = {f.split()[0]: pd.array([None], dtype="Int64") for f in fields}
                    yield pd.DataFrame({"file": [name]} | nothing | {"error": [f"{type(wrong).__name__}: {wrong}"]})

    schema = ", ".join(["file string", *fields, *(["error string"] if keep_errors else [])])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(cells, schema).withColumn("v", F.expr("nullif(v, -32768.0D)"))


def without_errors(rows: DataFrame, *, error: str = "error") -> DataFrame:
    """The rows of items that could be read, without the column of messages."""
    return rows.where(F.col(error).isNull()).drop(error)


def gridded_month(stack: DataFrame, year: int, month: int, box: tuple[float, float, float, float], *, nodata: float = -9999.0, value: str = "v") -> DataFrame:
    """One month of a daily stack (date, lat, lon, value) strictly inside (lat_min, lat_max, lon_min, lon_max)."""
    south, north, west, east = box
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    inside = (F.col("lat") > south) & (F.col("lat") < north) & (F.col("lon") > west) & (F.col("lon") < east)
    return stack.where((F.col("date") >= first) & (F.col("date") < F.add_months(first, 1)) & inside).withColumn(value, F.nullif(value, F.lit(nodata)))
