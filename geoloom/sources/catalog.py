"""Catalogs of files: what a tile or interval is made of, and the tags that its file carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def entries(files: DataFrame, *, path: str = "path", h: Column, v: Column, start: Column, end: Column, tags: dict[str, Column] | None = None) -> DataFrame:
    """(date_start, date_end, tile, file, tags) of listed files; tags are MAP<STRING, STRING> and may be empty."""
    pairs = [x for k, c in (tags or {}).items() for x in (F.lit(k), c.cast("string"))]
    marked = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return files.select(start.alias("date_start"), end.alias("date_end"), names.sinusoidal_tile_name(h, v).alias("tile"), F.col(path).alias("file"), marked.alias("tags"))


def of_product(catalog: DataFrame, tag: str, wanted: str) -> DataFrame:
    """The entries whose tag holds ``wanted``; an entry without the tag raises."""
    value = F.try_element_at("tags", F.lit(tag))
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"no tag {tag} in "), F.col("file"))).cast("string"))
    return catalog.where(checked.contains(wanted))


def first_match(granules: DataFrame, *, key: str, urls: str = "urls", suffix: str = "hdf") -> DataFrame:
    """Each granule's first address with the suffix; a granule without one raises."""
    return granules.select(key, names.first_with_suffix(F.col(urls), suffix).alias("url"))
