"""The terrain layers of a tile: a registry of named layers and their inputs, computed in one pass per tile.

Kernel layers are chained inside one grouped call on the tile with its overlap; focal, nearest and path layers are
relational and run on the cells that come out of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, with_halo
from ..operators import focal, lines, nearest, terrain
from ..scratch import Scratch


@dataclass(frozen=True)
class Layer:
    needs: tuple[str, ...]
    kernel: Callable[..., np.ndarray]


#: Name -> inputs and kernel. ``register`` adds to it.
LAYERS: dict[str, Layer] = {}


def register(name: str, *needs: str) -> Callable:
    def put(kernel: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
        LAYERS[name] = Layer(needs, kernel)
        return kernel

    return put


@register("dem_smooth", "dem")
def _smooth(dem, *, sigma=1.0, **_):
    return terrain.gaussian(dem, sigma)


@register("dem_cond", "dem_smooth")
def _cond(z, **_):
    return terrain.fill_depressions(z)


@register("slope", "dem_cond")
def _slope(z, *, pixel=30.0, **_):
    return terrain.slope(z, pixel)


@register("curvature", "dem_cond")
def _curvature(z, *, pixel=30.0, **_):
    return terrain.profile_curvature(z, pixel)


@register("flow_accum", "dem_cond")
def _accumulation(z, **_):
    return terrain.flow_accumulation(z)


@register("streams", "flow_accum")
def _streams(acc, *, stream_threshold=500, **_):
    return np.where(acc > stream_threshold, 1.0, np.nan)


@register("geomorphons", "dem_cond")
def _forms(z, *, search=100, flat_threshold=1.0, pixel=30.0, **_):
    return terrain.geomorphons(z, search, flat_threshold, 0, pixel)


@register("ridges", "geomorphons")
def _ridges(forms, *, ridge_size=30, **_):
    return terrain.ridges(forms, ridge_size)


def ordered(wanted: tuple[str, ...]) -> list[str]:
    """The wanted layers and what they need, inputs first; unknown names and circles raise."""
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name == "dem" or name in out:
            return
        if name in path:
            raise ValueError(f"layers need each other: {' > '.join((*path, name))}")
        if name not in LAYERS:
            raise KeyError(f"no layer {name!r}")
        for need in LAYERS[name].needs:
            visit(need, (*path, name))
        out.append(name)

    for name in wanted:
        visit(name, ())
    return out


def kernel_layers(dem: DataFrame, grid: Grid, wanted: tuple[str, ...], *, tile_size: int = 1000, halo: int = 100, value: str = "v", **options) -> DataFrame:
    """(row, col, dem, and a column per layer) of every cell, from its own tile. A group is one tile with its overlap."""
    names = ordered(wanted)

    def tile(cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(cells["row"].min()), int(cells["col"].min())
        shape = (int(cells["row"].max()) - r0 + 1, int(cells["col"].max()) - c0 + 1)
        at = (cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0)
        arrays = {"dem": np.full(shape, np.nan)}
        arrays["dem"][at] = cells["dem"].to_numpy(float)
        for name in names:
            layer = LAYERS[name]
            arrays[name] = layer.kernel(*[arrays[n] for n in layer.needs], **options)
        core = cells["in_core"].to_numpy()
        out = {"row": cells["row"][core], "col": cells["col"][core]} | {n: arrays[n][at][core] for n in ("dem", *names)}
        return pd.DataFrame(out)

    schema = "row int, col int, dem double, " + ", ".join(f"{n} double" for n in names)
    cells = with_halo(dem.select("row", "col", F.col(value).cast("double").alias("dem")), tile_size, halo, grid)
    found = cells.groupBy("tile_row", "tile_col").applyInPandas(tile, schema)
    return found.select("row", "col", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in ("dem", *names)])


def tile_features(dem: DataFrame, grid: Grid, *, value: str = "v", long_window: int = 41, short_window: int = 7, max_radius: int | None = None, **options) -> dict[str, DataFrame]:
    """All sixteen layers as DataFrames by name: the kernel layers, nearest streams and ridges, focal and path statistics."""
    wanted = ("dem_smooth", "dem_cond", "slope", "curvature", "flow_accum", "streams", "geomorphons", "ridges")
    base = Scratch(dem.sparkSession, "layers").table(kernel_layers(dem, grid, wanted, value=value, **options), "base")  # the kernels run once
    layer = lambda n: base.select("row", "col", F.col(n).alias("v"))
    streams = base.where("streams = 1").select("row", "col")
    ridge = base.where("ridges = 1").select("row", "col")
    out = {"dem": layer("dem")} | {n: layer(n) for n in wanted}
    out["nearest_stream_coords"] = to_stream = nearest.nearest_feature(layer("dem_cond"), streams, grid)
    out["nearest_ridge_coords"] = nearest.nearest_feature_unblocked(layer("dem_cond"), ridge, streams, grid, max_radius=max_radius)
    for name, source in (("grad", "slope"), ("hessian", "curvature")):
        out[f"long_{name}_stats"] = focal.square_stats(layer(source), long_window)
        out[f"short_{name}_stats"] = focal.square_stats(layer(source), short_window)
        paths = to_stream.select(F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("t_row").alias("row1"), F.col("t_col").alias("col1"))
        out[f"stream_{name}_stats"] = lines.path_stats(paths, layer(source))
    del out["short_hessian_stats"]
    return out
