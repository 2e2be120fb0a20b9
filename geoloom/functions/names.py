"""Names of tiles and files, and lists written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elevation_tile_name(lat: Column, lon: Column) -> Column:
    """NASADEM_HGT_{n|s}LL{e|w}LLL.zip of a one-degree cell."""
    ns = F.when(lat < 0, "s").otherwise("n")
    ew = F.when(lon < 0, "w").otherwise("e")
    return F.concat(F.lit("NASADEM_HGT_"), ns, F.lpad(F.abs(lat).cast("string"), 2, "0"), ew, F.lpad(F.abs(lon).cast("string"), 3, "0"), F.lit(".zip"))


def layer_tile_name(layer: Column, tile_row: Column, tile_col: Column) -> Column:
    return F.format_string("%s_tile_%03d_%03d.tif", layer, tile_row, tile_col)


def sinusoidal_tile_name(h: Column, v: Column) -> Column:
    return F.concat(F.lit("h"), h.cast("string"), F.lit("v"), v.cast("string"))


def parse_int_list(text: Column | str) -> Column:
    """ARRAY<INT> from '[x, y, w, h]' or '(row, col)'."""
    return F.from_json(F.translate(text, "()", "[]"), "array<int>")


def page_links(html: Column | str, suffix: str = "") -> Column:
    """The href targets in a page that end in ``suffix``."""
    links = F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
    return F.filter(links, lambda x: x.endswith(suffix)) if suffix else links


def first_with_suffix(urls: Column, suffix: str) -> Column:
    """The first of some addresses that ends in ``suffix``; raises if there is none."""
    found = F.get(F.filter(urls, lambda x: x.endswith(suffix)), F.lit(0))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit(f"no address ends in {suffix}")).cast("string"))
