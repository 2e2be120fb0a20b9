"""Points, polygons and cells: spatial joins with an equi-key on coarse squares, rasterisation, clipping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.union import union
from ..grid import Grid


def prepared(polygons: DataFrame, *, geom: str = "geom") -> DataFrame:
    """Polygons with their edges and bounds, which every predicate here reads."""
    b = geo.bounds(geom)
    return polygons.withColumn("__edges", geo.edges(geom)).withColumns({f"__{k}": v for k, v in b.items()})


def _squares(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def candidates(points: DataFrame, polygons: DataFrame, size: float, *, geom: str = "geom") -> DataFrame:
    """Pairs of a point (x, y) and a polygon whose bounds hold it; squares of side ``size`` are the join's key.

    A square gets only the edges that a ray from it to the right can meet: those of its band that reach as far. So an
    outline isn't copied to every square that it covers.
    """
    shapes = prepared(polygons, geom=geom)
    band, place = F.col("__sy"), F.col("__sx")
    crossed = lambda e: (F.floor(F.least(e["y1"], e["y2"]) / size) <= band) & (F.floor(F.greatest(e["y1"], e["y2"]) / size) >= band)
    shapes = shapes.withColumn("__sy", F.explode(_squares(F.col("__miny"), F.col("__maxy"), size))).withColumn("__edges", F.filter("__edges", crossed))
    ahead = lambda e: F.floor(F.greatest(e["x1"], e["x2"]) / size) >= place
    shapes = shapes.withColumn("__sx", F.explode(_squares(F.col("__minx"), F.col("__maxx"), size))).withColumn("__edges", F.filter("__edges", ahead))
    at = points.withColumns({"__sx": F.floor(F.col("x") / size), "__sy": F.floor(F.col("y") / size)})
    inside = F.col("x").between(F.col("__minx"), F.col("__maxx")) & F.col("y").between(F.col("__miny"), F.col("__maxy"))
    return at.join(shapes, ["__sx", "__sy"]).where(inside)


def points_within(points: DataFrame, polygons: DataFrame, *, point_key: str, polygon_columns: tuple[str, ...], size: float, geom: str = "geom", how: str = "left") -> DataFrame:
    """Every point with the columns of each polygon that it lies strictly within; a left join keeps points without any."""
    pairs = candidates(points, polygons, size, geom=geom).where(geo.within(F.col("__edges"), F.col("x"), F.col("y")))
    pairs = pairs.select(point_key, *polygon_columns)
    return points.join(pairs, point_key, how)


def first_polygon(points: DataFrame, polygons: DataFrame, *, point_key: str, polygon_key: str, size: float, geom: str = "geom") -> DataFrame:
    """Each point with one polygon that holds it (the smallest key), or NULL."""
    pairs = candidates(points, polygons, size, geom=geom).where(geo.intersects(F.col("__edges"), F.col("x"), F.col("y")))
    return points.join(pairs.groupBy(point_key).agg(F.min(polygon_key).alias(polygon_key)), point_key, "left")


def clip_points(points: DataFrame, polygons: DataFrame, *, point_key: str, size: float, geom: str = "geom") -> DataFrame:
    """Points inside or on the boundary of any polygon."""
    hits = candidates(points, polygons, size, geom=geom).where(geo.intersects(F.col("__edges"), F.col("x"), F.col("y")))
    return points.join(hits.select(point_key).distinct(), point_key, "left_semi")


def clip_to_box(polygons: DataFrame, minx: float, miny: float, maxx: float, maxy: float, *, geom: str = "geom") -> DataFrame:
    """Polygons cut to a box (Sutherland and Hodgman 1974), ring by ring; those that keep no area are dropped."""

    def clip(ring: Column, axis: str, limit: float, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda p: (p[axis] >= limit) if keep_above else (p[axis] <= limit)

        def crossing(p: Column, q: Column) -> Column:
            t = (F.lit(limit) - p[axis]) / (q[axis] - p[axis])
            o = p[other] + t * (q[other] - p[other])
            x, y = (F.lit(limit), o) if axis == "x" else (o, F.lit(limit))
            return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

        def edge(i: Column) -> Column:
            p, q = F.get(ring, i), F.get(ring, i + 1)
            return (
                F.when(inside(p) & inside(q), F.array(q))
                .when(inside(p), F.array(crossing(p, q)))
                .when(inside(q), F.array(crossing(p, q), q))
                .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            )

        open_ring = F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), edge))
        empty = F.array().cast("array<struct<x:double,y:double>>")
        clipped = F.when(F.size(ring) < 2, empty).otherwise(open_ring)
        return F.when(F.size(clipped) < 3, empty).otherwise(F.concat(clipped, F.slice(clipped, 1, 1)))

    def side(axis: str, limit: float, keep_above: bool):
        return lambda poly: F.filter(F.transform(poly, lambda r: clip(r, axis, limit, keep_above)), lambda r: F.size(r) > 0)

    out = polygons
    for axis, limit, above in (("x", minx, True), ("x", maxx, False), ("y", miny, True), ("y", maxy, False)):
        out = out.withColumn(geom, F.filter(F.transform(geom, side(axis, limit, above)), lambda p: F.size(p) > 0))
    return out.where(F.size(geom) > 0).where(geo.area(geom) > 0)


def dissolved(polygons: DataFrame, *, by: tuple[str, ...] = (), geom: str = "geom", fan: int = 16) -> DataFrame:
    """The union of each group's polygons: parts that don't overlap, so that areas add up and even-odd predicates hold.

    A group is united in ``fan`` shares first, which drop the edges inside them, and then as a whole; no group gives no
    row. Groups of nulls and of empty geometries have the empty geometry.
    """

    @F.udf(geo.GEOMETRY, useArrow=True)
    def united(values):
        shapes = [[[(v["x"], v["y"]) for v in ring] for ring in polygon] for polygon in values or []]
        return [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in union(shapes)]

    share = polygons.select(*by, F.pmod(F.xxhash64(F.to_json(geom)), F.lit(fan)).alias("__share"), geom)
    for keys in ((*by, "__share"), by):
        share = share.groupBy(*keys).agg(F.flatten(F.collect_list(geom)).alias(geom)).withColumn(geom, united(geom))
    return share


def simplified(polygons: DataFrame, tolerance: float, *, geom: str = "geom") -> DataFrame:
    """Rings without the vertices nearer than ``tolerance`` to the line that replaces them (Douglas and Peucker 1973).

    Rings that shrink below four vertices are dropped, and polygons without a first ring with them.
    """

    def ring(points: list) -> list:
        xy = np.array([(p["x"], p["y"]) for p in points], float)
        keep = np.zeros(len(xy), bool)
        far = int(np.argmax(((xy - xy[0]) ** 2).sum(axis=1)))  # a ring ends where it begins, so it is cut in two
        keep[[0, far, -1]] = True
        open_parts = [(0, far), (far, len(xy) - 1)]
        while open_parts:
            a, b = open_parts.pop()
            if b - a < 2:
                continue
            line, off = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            length = np.hypot(*line)
            gap = np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
            if gap.max() > tolerance:
                k = a + 1 + int(gap.argmax())
                keep[k] = True
                open_parts += [(a, k), (k, b)]
        return [points[k] for k in np.flatnonzero(keep)]

    @F.udf(geo.GEOMETRY, useArrow=True)
    def shape(value):
        if value is None:
            return None
        out = []
        for polygon in value:
            rings = [ring(r) for r in polygon]
            if rings and len(rings[0]) >= 4:
                out.append([r for r in rings if len(r) >= 4])
        return out

    return polygons.withColumn(geom, shape(F.col(geom)))


def zone_cells(polygons: DataFrame, grid: Grid, *, key: str, geom: str = "geom") -> DataFrame:
    """(key, row, col, small): cells whose centre a polygon holds; where a key has none, the cells that its edges meet.

    ``small`` marks the latter. Scan lines: an edge goes to the rows of cells that it crosses, and a row's sorted
    crossings are the ends of its runs of columns. Polygons that miss the grid give no rows, nor do null keys; of equal
    polygons of a key one counts.
    """
    shapes = prepared(polygons.where(F.col(key).isNotNull()), geom=geom)
    (ra, ca), (rb, cb) = grid.cell(F.col("__minx"), F.col("__miny")), grid.cell(F.col("__maxx"), F.col("__maxy"))
    reach = {"__r0": F.least(ra, rb), "__r1": F.greatest(ra, rb), "__c0": F.least(ca, cb), "__c1": F.greatest(ca, cb)}
    edge = shapes.withColumns(reach).select(key, F.xxhash64("__edges").alias("__id"), *reach, F.posexplode("__edges").alias("__i", "e"))
    (r1, c1), (r2, c2) = grid.cell(F.col("e.x1"), F.col("e.y1")), grid.cell(F.col("e.x2"), F.col("e.y2"))

    def span(a: Column, b: Column, size: int) -> Column:
        low, high = F.greatest(F.least(a, b) - 1, F.lit(0)), F.least(F.greatest(a, b) + 1, F.lit(size - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def columns(low: Column, high: Column) -> Column:
        """Columns from one x to another, and one more on either side; what lies between is up to a filter."""
        return span(grid.cell(low, F.lit(0.0))[1], grid.cell(high, F.lit(0.0))[1], grid.width)

    line = edge.withColumn("row", F.explode(span(r1, r2, grid.height)))
    e, y = F.col("e"), grid.centre(F.col("row"), F.lit(0))[1]
    at = lambda col: grid.centre(F.lit(0), col)[0]
    level = e["y1"] == e["y2"]
    crossing = F.when(~level, (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(~level, e["y2"] - e["y1"]) + e["x1"])
    meets = y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    on = F.filter(columns(F.coalesce(crossing, e["x1"]), F.coalesce(crossing, e["x2"])), lambda c: geo.on_edge(e, at(c), y))
    line = line.where(meets).select(key, "__id", "row", F.when((e["y1"] > y) != (e["y2"] > y), F.struct(crossing.alias("x"), F.col("__i").alias("i"))).alias("cut"), on.alias("on"))
    line = line.groupBy(key, "__id", "row").agg(F.transform(F.array_sort(F.collect_set("cut")), lambda c: c["x"]).alias("cut"), F.flatten(F.collect_set("on")).alias("on"))
    pairs = F.when(F.size("cut") > 1, F.sequence(F.lit(0), F.size("cut") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def run(k: Column) -> Column:
        low, high = F.get(F.col("cut"), k), F.get(F.col("cut"), k + 1)
        return F.filter(columns(low, high), lambda c: (at(c) >= low) & (at(c) < high))

    held = line.select(key, "row", F.array_distinct(F.concat(F.flatten(F.transform(pairs, run)), "on")).alias("cols")).where(F.size("cols") > 0)
    thin = edge.join(held.select(key).distinct(), key, "left_anti").withColumn("row", F.explode(span(r1, r2, grid.height)))
    y0, y1 = grid.corner(F.col("row"), F.lit(0))[1], grid.corner(F.col("row") + 1, F.lit(0))[1]
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    x_at = lambda y: F.when(level, e["x1"]).otherwise((e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(~level, e["y2"] - e["y1"]) + e["x1"])
    bottom, top = F.greatest(low, F.least(e["y1"], e["y2"])), F.least(high, F.greatest(e["y1"], e["y2"]))
    thin = thin.where(bottom <= top).withColumn("col", F.explode(columns(x_at(bottom), F.when(level, e["x2"]).otherwise(x_at(top)))))
    x0, x1 = grid.corner(F.lit(0), F.col("col"))[0], grid.corner(F.lit(0), F.col("col") + 1)[0]
    own = F.col("row").between(F.col("__r0"), F.col("__r1")) & F.col("col").between(F.col("__c0"), F.col("__c1"))
    thin = thin.where(own & geo.box_hits_edge(e, F.least(x0, x1), low, F.greatest(x0, x1), high)).select(key, "row", "col").distinct()
    centred = held.select(key, "row", F.explode("cols").alias("col"), F.lit(False).alias("small"))
    return centred.unionByName(thin.withColumn("small", F.lit(True)))


def mask_outside(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Cells that some zone holds."""
    return cells.join(zones.select("row", "col").distinct(), ["row", "col"], "left_semi")


def sample_points(points: DataFrame, rasters: dict[str, DataFrame], grid: Grid, *, key: str, value: str = "v") -> DataFrame:
    """Points (key, x, y) with a column per raster: the value of the cell that holds the point, or NULL."""
    row, col = grid.cell(F.col("x"), F.col("y"))
    out = points.withColumns({"row": row, "col": col})
    for name, cells in rasters.items():
        out = out.join(cells.select("row", "col", F.col(value).alias(name)), ["row", "col"], "left")
    return out
