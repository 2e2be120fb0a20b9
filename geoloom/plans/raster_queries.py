"""Queries of the raster operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid as grids
from ..operators import focal, lines, mosaic, nearest, spatial, terrain
from . import layers
from .tables import BARRIERS, LATTICE, NEAREST, STATS, TARGETS, barriers, grid, lattice, line_sql, moments_sql, rounded, table, targets

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _focal_sql(half: int, disc: bool = False) -> str:
    shape = f"AND (b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c) <= {half * half}" if disc else ""
    return f"""WITH {LATTICE}, w AS (
      SELECT a.r, a.c, b.v FROM lattice a JOIN lattice b
      ON b.r BETWEEN a.r - {half} AND a.r + {half} AND b.c BETWEEN a.c - {half} AND a.c + {half} {shape}),
    {moments_sql("w", "r, c")}
    SELECT s.r AS "row", s.c AS col, {", ".join(f"CASE WHEN l.v IS NOT NULL THEN s.{x} END AS {x}" for x in STATS)}
    FROM stats s JOIN lattice l ON s.r = l.r AND s.c = l.c"""


@query("focal_stats_7", _focal_sql(3))
def focal_7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(focal.square_stats(lattice(spark, sf), 7), *STATS)


@query("focal_stats_41", _focal_sql(20))
def focal_41(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(focal.square_stats(lattice(spark, sf), 41), *STATS)


@query("focal_disc_5", _focal_sql(5, disc=True))
def focal_disc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(focal.disc_stats(lattice(spark, sf), 5), *STATS)


@query(
    "focal_disc_points",
    f"""WITH {LATTICE}, p AS (SELECT c_custkey, CAST(c_custkey % 40 AS INT) AS pr, CAST((c_custkey * 7) % 100 AS INT) AS pc FROM customer),
    w AS (SELECT c_custkey, b.v FROM p JOIN lattice b ON (b.r - pr) * (b.r - pr) + (b.c - pc) * (b.c - pc) <= 25), {moments_sql("w", "c_custkey")}
    SELECT c_custkey, min, max, mean, var, skew, round(kurt - 3 + 1e-7, 4) AS kurt FROM stats""",
)
def focal_points(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select("c_custkey", F.expr("cast(c_custkey % 40 AS int)").alias("row"), F.expr("cast((c_custkey * 7) % 100 AS int)").alias("col"))
    return rounded(focal.disc_stats_at(p, lattice(spark, sf), 5, key="c_custkey"), *STATS)


@query(
    "slope_stencil",
    f"""WITH {LATTICE}, n AS (
      SELECT a.r, a.c, a.v, {", ".join(f"coalesce({k}.v, a.v) AS {k}" for k in ("e", "se", "s", "sw", "w", "nw", "n", "ne"))}
      FROM lattice a {" ".join(f"LEFT JOIN lattice {k} ON {k}.r = a.r + {dr} AND {k}.c = a.c + {dc}" for k, dr, dc in (("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1)))})
    SELECT r AS "row", c AS col, CASE WHEN v IS NOT NULL THEN round(degrees(atan(sqrt(
      power(((ne + 2 * e + se) - (nw + 2 * w + sw)) / 240.0, 2) + power(((sw + 2 * s + se) - (nw + 2 * n + ne)) / 240.0, 2)))) + 1e-7, 4) END AS slope FROM n""",
)
def slope(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(focal.slope(lattice(spark, sf)), "slope")


@query(
    "profile_curvature",
    f"""WITH {LATTICE}, n AS (
      SELECT a.r, a.c, CAST(a.v AS DOUBLE) AS v, {", ".join(f"CAST(coalesce({k}.v, a.v) AS DOUBLE) AS {k}" for k in ("e", "se", "s", "sw", "w", "nw", "n", "ne"))}
      FROM lattice a {" ".join(f"LEFT JOIN lattice {k} ON {k}.r = a.r + {dr} AND {k}.c = a.c + {dc}" for k, dr, dc in (("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1)))}),
    p AS (SELECT r, c, v, ((w + e) / 2 - v) / 900 AS d, ((n + s) / 2 - v) / 900 AS ee, (ne + sw - nw - se) / 3600 AS f, (e - w) / 60 AS g, (n - s) / 60 AS h FROM n)
    SELECT r AS "row", c AS col, CASE WHEN v IS NULL THEN NULL WHEN g * g + h * h > 0 THEN round(-2 * (d * g * g + ee * h * h + f * g * h) / (g * g + h * h) + 1e-7, 6) ELSE 0.0 END AS curvature FROM p""",
)
def curvature(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(focal.profile_curvature(lattice(spark, sf)), "curvature", to=6)


@query(
    "gaussian_smooth",
    f"""WITH {LATTICE}, p AS (SELECT a.r, a.c, any_value(a.v) AS v, sum(b.v * exp(-((a.r - b.r) ** 2 + (a.c - b.c) ** 2) / 2.0)) AS x, sum(exp(-((a.r - b.r) ** 2 + (a.c - b.c) ** 2) / 2.0)) AS w
      FROM lattice a LEFT JOIN lattice b ON b.v IS NOT NULL AND b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY 1, 2)
    SELECT r AS "row", c AS col, CASE WHEN v IS NOT NULL THEN round(x / w + 1e-7, 4) END AS smooth FROM p""",
)
def gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(focal.gaussian(lattice(spark, sf)), "smooth")


@query("streams_threshold", f'WITH {LATTICE} SELECT r AS "row", c AS col, CASE WHEN value > 300 THEN 1 END AS stream FROM lattice')
def streams(spark: SparkSession, sf: str) -> DataFrame:
    return focal.streams(lattice(spark, sf), value="value", threshold=300)


_PAIRS = """pairs AS (SELECT o_orderkey, CAST(o_orderkey % 37 AS INT) AS r0, CAST((o_orderkey * 3) % 53 AS INT) AS c0,
  CAST((o_orderkey * 5) % 41 AS INT) AS r1, CAST(o_orderkey % 59 AS INT) AS c1 FROM orders)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    ends = {"row0": "o_orderkey % 37", "col0": "(o_orderkey * 3) % 53", "row1": "(o_orderkey * 5) % 41", "col1": "o_orderkey % 59"}
    return table(spark, sf, "orders").select("o_orderkey", *[F.expr(f"cast({e} AS int)").alias(k) for k, e in ends.items()])


@query("line_cells", f"""WITH {_PAIRS}, {line_sql("pairs", "o_orderkey")} SELECT o_orderkey, step, lr AS "row", lc AS col FROM line""")
def line_cells(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_cells(_pairs(spark, sf), keep=("o_orderkey",))


@query(
    "thick_line_cells",
    f"""WITH {_PAIRS}, {line_sql("pairs", "o_orderkey")} SELECT DISTINCT o_orderkey, lr + a AS "row", lc + b AS col
    FROM line, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE step > 0""",
)
def thick_cells(spark: SparkSession, sf: str) -> DataFrame:
    return lines.thick_line_cells(_pairs(spark, sf), keep=("o_orderkey",))


@query("burn_lines", f"""WITH {_PAIRS}, {line_sql("pairs", "o_orderkey")} SELECT lr AS "row", lc AS col, max(o_orderkey) % 7 AS value FROM line GROUP BY lr, lc""")
def burn(spark: SparkSession, sf: str) -> DataFrame:
    return lines.burn(_pairs(spark, sf).withColumns({"value": F.col("o_orderkey") % 7, "seq": F.col("o_orderkey")}))


@query("spiral_offsets", "SELECT dr, dc, dr * dr + dc * dc AS d2 FROM (SELECT unnest(range(-9, 10)) AS dr), (SELECT unnest(range(-9, 10)) AS dc)")
def spiral(spark: SparkSession, sf: str) -> DataFrame:
    return lines.spiral_offsets(spark, 10)


@query("nearest_target", f'WITH {TARGETS}, {NEAREST} SELECT r AS "row", c AS col, tr AS t_row, tc AS t_col, d2 FROM near')
def nearest_target(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    return nearest.nearest_target(cells, targets(cells))


@query(
    "nearest_stream",
    f"""WITH {TARGETS}, {NEAREST} SELECT n.r AS "row", n.c AS col, tr AS t_row, tc AS t_col, 1000.0 + (tc + 0.5) * 30 AS x, 50000.0 - (tr + 0.5) * 30 AS y, z.value AS z
    FROM near n JOIN lattice l ON l.r = n.r AND l.c = n.c JOIN lattice z ON z.r = tr AND z.c = tc""",
)
def nearest_stream(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    return nearest.nearest_feature(cells, targets(cells), grid(cells), value="value")


@query(
    "nearest_ridge_constrained",
    f"""WITH {BARRIERS},
    origin AS (SELECT l.r AS r0, l.c AS c0, EXISTS (SELECT 1 FROM targets t WHERE t.r = l.r AND t.c = l.c) AS own,
                      EXISTS (SELECT 1 FROM barriers b WHERE b.r = l.r AND b.c = l.c) AS free FROM lattice l),
    cand AS (SELECT r0, c0, own, free, t.r AS r1, t.c AS c1, (t.r - r0) * (t.r - r0) + (t.c - c0) * (t.c - c0) AS d2,
                    greatest(abs(t.r - r0), abs(t.c - c0)) AS n, least(abs(t.r - r0), abs(t.c - c0)) AS m, abs(t.r - r0) > abs(t.c - c0) AS steep
             FROM origin, targets t WHERE NOT own OR (t.r = r0 AND t.c = c0)),
    met AS (SELECT r0, c0, r1, c1, steep, n, m, abs(b.r - r0) AS br, abs(b.c - c0) AS bc FROM cand JOIN barriers b
            ON b.r BETWEEN least(r0, r1) AND greatest(r0, r1) AND b.c BETWEEN least(c0, c1) AND greatest(c0, c1) WHERE NOT own AND NOT free AND n > 0),
    hit AS (SELECT DISTINCT r0, c0, r1, c1 FROM met WHERE CASE WHEN steep THEN bc = (2 * br * m + n - 1) // (2 * n) ELSE br = (2 * bc * m + n - 1) // (2 * n) END),
    ok AS (SELECT *, row_number() OVER (PARTITION BY r0, c0 ORDER BY d2, r1, c1) AS nth FROM cand ANTI JOIN hit USING (r0, c0, r1, c1))
    SELECT o.r0 AS "row", o.c0 AS col, ok.r1 AS t_row, ok.c1 AS t_col, 1000.0 + (ok.c1 + 0.5) * 30 AS x, 50000.0 - (ok.r1 + 0.5) * 30 AS y, z.value AS z
    FROM origin o LEFT JOIN ok ON ok.r0 = o.r0 AND ok.c0 = o.c0 AND nth = 1 LEFT JOIN lattice z ON z.r = ok.r1 AND z.c = ok.c1""",
)
def nearest_ridge(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    return nearest.nearest_feature_unblocked(cells, targets(cells), barriers(cells), grid(cells), value="value")


@query(
    "stream_path_stats",
    f"""WITH {TARGETS}, {NEAREST}, paths AS (SELECT n.r AS r0, n.c AS c0, tr AS r1, tc AS c1 FROM near n JOIN lattice l ON l.r = n.r AND l.c = n.c WHERE l.v IS NOT NULL),
    {line_sql("paths")}, w AS (SELECT r0, c0, l.v FROM line LEFT JOIN lattice l ON l.r = lr AND l.c = lc), {moments_sql("w", "r0, c0")}
    SELECT r0 AS row0, c0 AS col0, min, max, mean, var, skew, kurt FROM stats""",
)
def path_stats(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    near = nearest.nearest_target(cells, targets(cells))
    paths = near.select(F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("t_row").alias("row1"), F.col("t_col").alias("col1"))
    return rounded(lines.raster_path_stats(paths, cells, valued=True), *STATS)


@query(
    "gap_fill_nearest",
    f"""WITH {LATTICE}, known AS (SELECT r, c, v FROM lattice WHERE v IS NOT NULL),
    near AS (SELECT l.r, l.c, k.v, row_number() OVER (PARTITION BY l.r, l.c ORDER BY (l.r - k.r) ** 2 + (l.c - k.c) ** 2, k.r, k.c) AS nth
             FROM lattice l JOIN known k ON k.r BETWEEN l.r - 25 AND l.r + 25 AND k.c BETWEEN l.c - 25 AND l.c + 25 WHERE l.v IS NULL)
    SELECT r AS "row", c AS col, v FROM known UNION ALL SELECT r, c, v FROM near WHERE nth = 1""",
)
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.fill_from_nearest(lattice(spark, sf).select("row", "col", "v", "value"), where="value")


def _three(spark: SparkSession, sf: str) -> list[DataFrame]:
    cells = lattice(spark, sf)
    return [cells.where(F.col("event_type").isin(*kinds)).select("row", "col", "v") for kinds in (("view", "click", "error"), ("click", "purchase"), ("error", "signup", "purchase"))]


@query("mosaic_last_wins", f'WITH {LATTICE} SELECT r AS "row", c AS col, v FROM lattice')
def mosaic_last(spark: SparkSession, sf: str) -> DataFrame:
    return mosaic.overlay(_three(spark, sf))


@query(
    "mosaic_max",
    f"""WITH {LATTICE}, pair AS (SELECT r, c, v FROM lattice UNION ALL SELECT r, 99 - c, v FROM lattice) SELECT r AS "row", c AS col, max(v) AS v FROM pair GROUP BY r, c""",
)
def mosaic_max(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf).select("row", "col", "v")
    return mosaic.reduce_max([cells, cells.withColumn("col", 99 - F.col("col"))])


@query("downsample_mean", f'WITH {LATTICE} SELECT CAST(r // 4 AS INT) AS "row", CAST(c // 4 AS INT) AS col, round(avg(v) + 1e-7, 4) AS v FROM lattice GROUP BY ALL')
def downsample_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mosaic.downsample(lattice(spark, sf), 4), "v")


@query(
    "downsample_mode",
    f"""WITH {LATTICE}, n AS (SELECT r // 5 AS br, c // 5 AS bc, event_type, count(*) AS n FROM lattice GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY br, bc ORDER BY n DESC, event_type) AS nth FROM n)
    SELECT CAST(br AS INT) AS "row", CAST(bc AS INT) AS col, event_type FROM f WHERE nth = 1""",
)
def downsample_mode(spark: SparkSession, sf: str) -> DataFrame:
    return mosaic.downsample(lattice(spark, sf), 5, value="event_type", method="mode")


@query(
    "pyramid",
    f"""WITH {LATTICE}, l AS (SELECT unnest([2, 4, 8, 16]) AS level)
    SELECT level, CAST(r // level AS INT) AS "row", CAST(c // level AS INT) AS col, round(avg(v) + 1e-7, 4) AS v FROM lattice, l GROUP BY ALL""",
)
def pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mosaic.pyramid(lattice(spark, sf)), "v")


@query(
    "resample_bilinear",
    f"""WITH {LATTICE}, size AS (SELECT max(r) + 1 AS h FROM lattice),
    t AS (SELECT unnest(range(0, CAST(h AS BIGINT) // 2)) AS tr, (SELECT NULL) AS x FROM size), g AS (SELECT tr, tc FROM t, (SELECT unnest(range(0, 60)) AS tc)),
    f AS (SELECT tr, tc, (tr + 0.5) * 1.7 - 0.5 AS fy, (tc + 0.5) * 1.6 - 0.5 AS fx FROM g),
    q AS (SELECT tr, tc, fy, fx, a, b, CAST(floor(fy) AS INT) + a AS sr, CAST(floor(fx) AS INT) + b AS sc,
            (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
          FROM f, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
    SELECT CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) + 1e-7, 4) AS v
    FROM q LEFT JOIN lattice l ON l.r = sr AND l.c = sc WHERE w > 0 GROUP BY ALL""",
)
def resample(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    g = grid(cells)
    source = grids.Grid(1.0, 0.0, 1.0, 0.0, g.width, g.height)
    return rounded(mosaic.resample(cells, source, grids.Grid(1.6, 0.0, 1.7, 0.0, 60, g.height // 2)), "v")


@query(
    "tile_grid",
    f"""WITH {LATTICE}, size AS (SELECT CAST(ceil((max(r) + 1) / 32.0) AS BIGINT) AS down FROM lattice), t AS (SELECT unnest(range(0, down)) AS tr FROM size)
    SELECT CAST(tr AS INT) AS tile_row, CAST(tc AS INT) AS tile_col, 4 AS crop_x_offset, 4 AS crop_y_offset, 1000.0 + tc * 32 * 30 AS minx, 50000.0 - (tr + 1) * 32 * 30 AS miny,
      1000.0 + (tc + 1) * 32 * 30 AS maxx, 50000.0 - tr * 32 * 30 AS maxy, tc * 32 - 4 AS ovlp_x, tr * 32 - 4 AS ovlp_y, 40 AS ovlp_size FROM t, (SELECT unnest(range(0, 4)) AS tc)""",
)
def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    tiles = grids.tile_grid(spark, grid(lattice(spark, sf)), 32, 120.0)
    box = F.col("ovlp_bbox")
    return tiles.withColumns({"ovlp_x": box[0], "ovlp_y": box[1], "ovlp_size": box[2]}).drop("core_bbox", "ovlp_bbox")


@query("tile_assign", f"WITH {LATTICE} SELECT CAST(r // 32 AS INT) AS tile_row, CAST(c // 32 AS INT) AS tile_col, count(*) AS cells, count(v) AS known FROM lattice GROUP BY ALL")
def tile_assign(spark: SparkSession, sf: str) -> DataFrame:
    return grids.with_tile(lattice(spark, sf), 32).groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"), F.count("v").alias("known"))


@query(
    "tiles_with_points",
    f"""WITH {LATTICE}, size AS (SELECT CAST(ceil((max(r) + 1) / 10.0) AS INT) AS down FROM lattice),
    p AS (SELECT (c_custkey % 97) * 1.0 AS x, (c_custkey % 89) * 0.5 AS y FROM customer),
    a AS (SELECT x / 10 AS tx, y / 10 AS ty FROM p),
    t AS (SELECT DISTINCT unnest([floor(ty), ceil(ty) - 1]) AS tr, tx FROM a), u AS (SELECT DISTINCT tr, unnest([floor(tx), ceil(tx) - 1]) AS tc FROM t)
    SELECT DISTINCT CAST(tr AS INT) AS tile_row, CAST(tc AS INT) AS tile_col FROM u, size WHERE tr >= 0 AND tr < down AND tc >= 0 AND tc < 10""",
)
def tiles_with_points(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(lattice(spark, sf))
    points = table(spark, sf, "customer").select(((F.col("c_custkey") % 97) * 1.0).alias("x"), ((F.col("c_custkey") % 89) * 0.5).alias("y"))
    return grids.tiles_touched(points, grids.Grid(1.0, 0.0, 1.0, 0.0, g.width, g.height), 10)


@query("crop_core", f'WITH {LATTICE} SELECT r AS "row", c AS col, v, CAST(r // 25 AS INT) AS tile_row, CAST(c // 25 AS INT) AS tile_col FROM lattice')
def crop_core(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf).select("row", "col", "v")
    return grids.crop_core(grids.with_halo(cells, 25, 6, grid(cells)), 25).select("row", "col", "v", "tile_row", "tile_col")


@query(
    "window_read",
    f"""WITH {LATTICE}, w AS (SELECT a AS r, unnest(range(90, 110)) AS c FROM (SELECT unnest(range(-2, 9)) AS a))
    SELECT CAST(w.r AS INT) AS "row", CAST(w.c AS INT) AS col, v FROM w LEFT JOIN lattice l ON l.r = w.r AND l.c = w.c""",
)
def window_read(spark: SparkSession, sf: str) -> DataFrame:
    """A window that reaches beyond the upper and the right edge."""
    return grids.window(lattice(spark, sf).select("row", "col", "v"), -2, 90, 11, 20, fill=True)


@query(
    "point_sample",
    f"""WITH {LATTICE}, p AS (SELECT c_custkey, 1000.0 + (c_custkey % 300) * 11.0 AS x, 50000.0 - (c_custkey % 7) * 41.0 AS y FROM customer),
    q AS (SELECT *, CAST(floor((y - 50000.0) / -30) AS INT) AS r, CAST(floor((x - 1000.0) / 30) AS INT) AS c FROM p)
    SELECT c_custkey, x, y, q.r AS "row", q.c AS col, l.v AS known, l.value AS raw FROM q LEFT JOIN lattice l ON l.r = q.r AND l.c = q.c""",
)
def point_sample(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    p = table(spark, sf, "customer").select("c_custkey", (F.lit(1000.0) + (F.col("c_custkey") % 300) * 11.0).alias("x"), (F.lit(50000.0) - (F.col("c_custkey") % 7) * 41.0).alias("y"))
    rasters = {"known": cells.select("row", "col", "v"), "raw": cells.select("row", "col", F.col("value").alias("v"))}
    return spatial.sample_points(p, rasters, grid(cells), key="c_custkey").select("c_custkey", "x", "y", "row", "col", "known", "raw")


def _dem(spark: SparkSession, sf: str) -> tuple[DataFrame, grids.Grid]:
    cells = lattice(spark, sf).select("row", "col", (F.col("v") / 10 + F.col("row")).alias("v"))
    return cells, grid(cells)


@query("tile_layers")
def tile_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothing, fill, slope, curvature, accumulation, streams, forms and ridges, each tile on its own with overlap."""
    dem, g = _dem(spark, sf)
    names = ("dem_smooth", "dem_cond", "slope", "curvature", "flow_accum", "streams", "geomorphons", "ridges")
    found = layers.kernel_layers(dem, g, names, tile_size=50, halo=10, search=10, stream_threshold=20, ridge_size=4)
    return rounded(found, *names)


def _one_layer(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        dem, g = _dem(spark, sf)
        return rounded(layers.kernel_layers(dem, g, (name,), tile_size=50, halo=10, search=10, stream_threshold=20, ridge_size=4).select("row", "col", name), name)

    return run


#: The kernel layers in SQL, tile by tile: smoothing, the lowest way out to an edge or to nodata, and the eight neighbours.
_TILES = f"""WITH RECURSIVE {LATTICE}, cells AS MATERIALIZED (
      SELECT tr, tc, r, c, r // 50 = tr AND c // 50 = tc AS core, v / 10 + r AS v FROM lattice
      JOIN (SELECT DISTINCT r // 50 AS tr FROM lattice) ON r BETWEEN tr * 50 - 10 AND tr * 50 + 59
      JOIN (SELECT DISTINCT c // 50 AS tc FROM lattice) ON c BETWEEN tc * 50 - 10 AND tc * 50 + 59),
    taps AS (SELECT a.k AS dr, b.k AS dc, exp(-(a.k * a.k + b.k * b.k) / 2.0) AS w FROM (SELECT unnest(range(-3, 4)) AS k) a, (SELECT unnest(range(-3, 4)) AS k) b),
    smooth AS MATERIALIZED (
      SELECT a.tr, a.tc, a.r, a.c, a.core, sum(t.w * b.v) / sum(t.w) AS z FROM cells a CROSS JOIN taps t
      JOIN cells b ON b.tr = a.tr AND b.tc = a.tc AND b.r = a.r + t.dr AND b.c = a.c + t.dc WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL),
    eight AS (SELECT * FROM (VALUES {", ".join(f"({k}, {dr}, {dc}, {(dr * dr + dc * dc) ** 0.5!r})" for k, (dr, dc) in enumerate(terrain.EIGHT))}) AS e(k, dr, dc, far)),
    outlets AS MATERIALIZED (
      SELECT a.tr, a.tc, a.r, a.c, any_value(a.z) AS w FROM smooth a CROSS JOIN eight e
      LEFT JOIN smooth b ON b.tr = a.tr AND b.tc = a.tc AND b.r = a.r + e.dr AND b.c = a.c + e.dc
      GROUP BY a.tr, a.tc, a.r, a.c HAVING count(b.z) < 8),
    flood(tr, tc, r, c, w) USING KEY (tr, tc, r, c) AS (
      SELECT * FROM outlets
      UNION
      SELECT b.tr, b.tc, b.r, b.c, min(greatest(b.z, f.w)) FROM flood f CROSS JOIN eight e
      JOIN smooth b ON b.tr = f.tr AND b.tc = f.tc AND b.r = f.r + e.dr AND b.c = f.c + e.dc
      LEFT JOIN recurring.flood g ON g.tr = b.tr AND g.tc = b.tc AND g.r = b.r AND g.c = b.c
      WHERE g.w IS NULL OR greatest(b.z, f.w) < g.w GROUP BY b.tr, b.tc, b.r, b.c),
    filled AS MATERIALIZED (SELECT tr, tc, r, c, w AS z FROM flood)"""
_CORE = "FROM cells s LEFT JOIN {0} f ON f.tr = s.tr AND f.tc = s.tc AND f.r = s.r AND f.c = s.c WHERE s.core"
_KERNEL_SQL = {
    "fill_depressions": f'{_TILES} SELECT s.r AS "row", s.c AS col, round(f.z + 1e-7, 4) AS dem_cond {_CORE.format("filled")}',
    "d8_accumulation": f"""{_TILES}, ways AS MATERIALIZED (
      SELECT a.tr, a.tc, a.r, a.c, arg_min(a.r + e.dr, struct_pack(d := (b.z - a.z) / e.far, k := e.k)) AS r1, arg_min(a.c + e.dc, struct_pack(d := (b.z - a.z) / e.far, k := e.k)) AS c1
      FROM filled a CROSS JOIN eight e JOIN filled b ON b.tr = a.tr AND b.tc = a.tc AND b.r = a.r + e.dr AND b.c = a.c + e.dc WHERE b.z < a.z GROUP BY a.tr, a.tc, a.r, a.c),
    walk AS (SELECT tr, tc, r, c FROM filled UNION ALL SELECT w.tr, w.tc, y.r1, y.c1 FROM walk w JOIN ways y ON y.tr = w.tr AND y.tc = w.tc AND y.r = w.r AND y.c = w.c),
    passed AS (SELECT tr, tc, r, c, CAST(count(*) AS DOUBLE) AS n FROM walk GROUP BY ALL)
    SELECT s.r AS "row", s.c AS col, f.n AS flow_accum {_CORE.format("passed")}""",
    "geomorphons": f"""{_TILES}, sight AS (
      SELECT a.tr, a.tc, a.r, a.c, e.k, max(degrees(atan((b.z - a.z) / (s * e.far * 30)))) AS most, min(degrees(atan((b.z - a.z) / (s * e.far * 30)))) AS least
      FROM filled a CROSS JOIN eight e CROSS JOIN (SELECT unnest(range(1, 11)) AS s)
      JOIN filled b ON b.tr = a.tr AND b.tc = a.tc AND b.r = a.r + s * e.dr AND b.c = a.c + s * e.dc GROUP BY ALL),
    marks AS (SELECT tr, tc, r, c, count(*) FILTER ((90 + least) - (90 - most) > 1) AS higher, count(*) FILTER ((90 - most) - (90 + least) > 1) AS lower FROM sight GROUP BY ALL),
    forms AS (SELECT * FROM (VALUES {", ".join(f"({low}, {high}, {form})" for low, line in enumerate(terrain.FORMS) for high, form in enumerate(line))}) AS x(low, high, form)),
    named AS (SELECT a.tr, a.tc, a.r, a.c, CAST(x.form AS DOUBLE) AS form FROM filled a LEFT JOIN marks m ON m.tr = a.tr AND m.tc = a.tc AND m.r = a.r AND m.c = a.c
      JOIN forms x ON x.low = coalesce(m.lower, 0) AND x.high = coalesce(m.higher, 0))
    SELECT s.r AS "row", s.c AS col, f.form AS geomorphons {_CORE.format("named")}""",
}

for _name, _layer in (("fill_depressions", "dem_cond"), ("d8_accumulation", "flow_accum"), ("geomorphons", "geomorphons"), ("ridges", "ridges")):
    query(_name, _KERNEL_SQL.get(_name))(_one_layer(_layer))


@query("tile_features")
def tile_features(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and known values of each of the sixteen layers."""
    dem, g = _dem(spark, sf)
    found = layers.tile_features(dem, g, long_window=11, short_window=7, tile_size=50, halo=10, search=10, stream_threshold=20, ridge_size=4)
    value = {n: next(c for c in ("v", "mean", "t_row") if c in d.columns) for n, d in found.items()}
    counts = [d.agg(F.lit(n).alias("layer"), F.count("*").alias("cells"), F.count(value[n]).alias("known")) for n, d in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
