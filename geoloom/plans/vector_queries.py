"""Queries of the polygon operators, on octagons around each nation's pseudo-position."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.projection import Albers
from ..grid import Grid
from ..operators import observations, spatial
from .tables import grid, lattice, rounded, table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """An octagon of nationkey-dependent size round (20 (key % 5) + 10, 20 (key div 5) + 10); corners are at whole numbers."""
    n = F.col("n_nationkey")
    x, y, a = (n % 5) * 20 + 10, F.expr("n_nationkey div 5") * 20 + 10, n % 7 + 4
    corner = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2), (1, 2)]
    ring = F.array(*[F.struct((x + a * i).cast("double").alias("x"), (y + a * j).cast("double").alias("y")) for i, j in corner])
    return table(spark, sf, "nation").select("n_nationkey", "n_name", F.array(F.array(ring)).alias("geom"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", ((k * 7) % 211 / 2).alias("x"), ((k * 13) % 223 / 2).alias("y"))


_POLY = """corner AS (SELECT unnest(range(0, 9)) AS i, unnest([1, 2, 2, 1, -1, -2, -2, -1, 1]) AS cx, unnest([2, 1, -1, -2, -2, -1, 1, 2, 2]) AS cy),
  vert AS (SELECT n_nationkey AS k, i, (n_nationkey % 5) * 20 + 10 + (n_nationkey % 7 + 4) * cx AS x, (n_nationkey // 5) * 20 + 10 + (n_nationkey % 7 + 4) * cy AS y FROM nation, corner),
  edge AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vert a JOIN vert b ON a.k = b.k AND b.i = a.i + 1),
  pt AS (SELECT c_custkey, (c_custkey * 7) % 211 / 2 AS x, (c_custkey * 13) % 223 / 2 AS y FROM customer),
  hit AS (SELECT c_custkey, k, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
      bool_or((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
    FROM pt, edge GROUP BY 1, 2)"""


@query("point_in_polygon", f"WITH {_POLY}, w AS (SELECT c_custkey, k FROM hit WHERE odd AND NOT edge) SELECT p.c_custkey, p.x, p.y, w.k AS n_nationkey FROM pt p LEFT JOIN w ON w.c_custkey = p.c_custkey")
def within(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.points_within(points(spark, sf), polygons(spark, sf), point_key="c_custkey", polygon_columns=("n_nationkey",), size=20.0)


@query("point_first_polygon", f"WITH {_POLY} SELECT p.c_custkey, p.x, p.y, min(CASE WHEN odd OR edge THEN k END) AS n_nationkey FROM pt p JOIN hit h ON h.c_custkey = p.c_custkey GROUP BY ALL")
def first_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.first_polygon(points(spark, sf), polygons(spark, sf), point_key="c_custkey", polygon_key="n_nationkey", size=20.0)


@query("clip_points", f"WITH {_POLY} SELECT c_custkey, x, y FROM pt WHERE c_custkey IN (SELECT c_custkey FROM hit WHERE odd OR edge)")
def clip_points(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.clip_points(points(spark, sf), polygons(spark, sf), point_key="c_custkey", size=20.0)


@query("polygon_area", "SELECT n_nationkey, 14.0 * (n_nationkey % 7 + 4) ** 2 / 1e6 AS area FROM nation")
def area(spark: SparkSession, sf: str) -> DataFrame:
    return polygons(spark, sf).select("n_nationkey", geo.area_km2("geom").alias("area"))


@query("bbox_buffer", f"WITH {_POLY} SELECT k AS n_nationkey, CAST(floor(min(x) - 2.5) AS BIGINT) AS minx, CAST(floor(min(y) - 2.5) AS BIGINT) AS miny, CAST(ceil(max(x) + 2.5) AS BIGINT) AS maxx, CAST(ceil(max(y) + 2.5) AS BIGINT) AS maxy FROM vert GROUP BY 1")
def buffered(spark: SparkSession, sf: str) -> DataFrame:
    return polygons(spark, sf).select("n_nationkey", *[c.alias(k) for k, c in geo.buffered_bounds("geom", 2.5).items()])


@query("total_bounds", f"WITH {_POLY} SELECT CAST(min(x) AS DOUBLE) AS minx, CAST(min(y) AS DOUBLE) AS miny, CAST(max(x) AS DOUBLE) AS maxx, CAST(max(y) AS DOUBLE) AS maxy FROM vert")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    each = polygons(spark, sf).select(*[c.alias(k) for k, c in geo.bounds("geom").items()])
    return each.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


@query("bbox_filter", f"WITH {_POLY} SELECT k AS n_nationkey FROM vert GROUP BY 1 HAVING min(x) <= 40 AND max(x) >= 15 AND min(y) <= 60 AND max(y) >= 33")
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    box = {"minx": F.lit(15), "miny": F.lit(33), "maxx": F.lit(40), "maxy": F.lit(60)}
    return polygons(spark, sf).where(geo.boxes_overlap(geo.bounds("geom"), box)).select("n_nationkey")


@query("usable_geometries", "SELECT n_nationkey, n_nationkey % 4 <> 0 AS usable FROM nation")
def usable(spark: SparkSession, sf: str) -> DataFrame:
    open_ring = F.transform("geom", lambda p: F.transform(p, lambda r: F.slice(r, 1, 3)))
    broken = polygons(spark, sf).withColumn("geom", F.when(F.col("n_nationkey") % 4 == 0, open_ring).otherwise(F.col("geom")))
    return broken.select("n_nationkey", geo.is_usable("geom").alias("usable"))


@query(
    "zone_cells",
    f"""WITH {_POLY}, h AS (SELECT CAST((max(event_id) // 100) + 1 AS INT) AS h FROM events), cell AS (SELECT r, c, c + 0.5 AS x, r + 0.5 AS y FROM (SELECT unnest(range(0, h)) AS r FROM h), (SELECT unnest(range(0, 100)) AS c)),
    z AS (SELECT k, r, c, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
      bool_or((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge FROM cell, edge GROUP BY 1, 2, 3)
    SELECT k AS n_nationkey, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, false AS small FROM z WHERE odd OR edge""",
)
def zone_cells(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(lattice(spark, sf))
    return spatial.zone_cells(polygons(spark, sf), Grid(1.0, 0.0, 1.0, 0.0, g.width, g.height), key="n_nationkey")


@query(
    "cutline_mask",
    f"""WITH {_POLY}, cell AS (SELECT CAST(event_id // 100 AS INT) AS r, CAST(event_id % 100 AS INT) AS c, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
    z AS (SELECT k, r, c, any_value(v) AS v, sum(CASE WHEN (y1 > r + 0.5) <> (y2 > r + 0.5) AND c + 0.5 < (x2 - x1) * (r + 0.5 - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
      bool_or((c + 0.5 - x1) * (y2 - y1) - (r + 0.5 - y1) * (x2 - x1) = 0 AND c + 0.5 BETWEEN least(x1, x2) AND greatest(x1, x2) AND r + 0.5 BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
      FROM cell, edge WHERE k = 6 OR k = 13 GROUP BY 1, 2, 3)
    SELECT r AS "row", c AS col, any_value(v) AS v FROM z WHERE odd OR edge GROUP BY 1, 2""",
)
def cutline_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The raster within a cutline of two polygons."""
    cells = lattice(spark, sf)
    g = grid(cells)
    zones = spatial.zone_cells(polygons(spark, sf).where("n_nationkey IN (6, 13)"), Grid(1.0, 0.0, 1.0, 0.0, g.width, g.height), key="n_nationkey")
    return spatial.mask_outside(cells.select("row", "col", "v"), zones.where("NOT small"))


@query(
    "clip_to_box",
    """WITH o AS (SELECT n_nationkey, (n_nationkey % 5) * 20 + 10 AS cx, (n_nationkey // 5) * 20 + 10 AS cy, n_nationkey % 7 + 4 AS a FROM nation),
    s AS (SELECT *, unnest(range(0, 50)) + 0.5 AS y FROM o),
    w AS (SELECT n_nationkey, cx, CASE WHEN abs(y - cy) <= a THEN 2 * a WHEN abs(y - cy) <= 2 * a THEN 3 * a - abs(y - cy) END AS h FROM s),
    b AS (SELECT n_nationkey, CAST(greatest(0, least(cx + h, 50) - greatest(cx - h, 0)) AS DOUBLE) AS wide FROM w WHERE h IS NOT NULL)
    SELECT n_nationkey, round(sum(wide) + 1e-7, 4) AS area FROM b GROUP BY 1 HAVING sum(wide) > 0""",
)
def clip_box(spark: SparkSession, sf: str) -> DataFrame:
    cut = spatial.clip_to_box(polygons(spark, sf), 0.0, 0.0, 50.0, 50.0)
    return rounded(cut.select("n_nationkey", geo.area("geom").alias("area")), "area")


@query(
    "basin_enrichment",
    f"""WITH {_POLY}, w AS (SELECT c_custkey, k, 14.0 * (k % 7 + 4) ** 2 / 1e6 AS a FROM hit WHERE odd AND NOT edge)
    SELECT p.c_custkey, w.k AS n_nationkey, CASE WHEN a < 100 THEN 30 ELSE 360 END AS climdata_period_days, DATE '2010-05-01' - 60 AS climdata_date_start
    FROM pt p LEFT JOIN w ON w.c_custkey = p.c_custkey""",
)
def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    obs = points(spark, sf).withColumn("DATE", F.lit("2010-05-01").cast("date"))
    found = observations.enriched(obs, polygons(spark, sf), keep=("n_nationkey",), size=20.0, point_key="c_custkey")
    return found.select("c_custkey", "n_nationkey", "climdata_period_days", "climdata_date_start")


def _albers_sql() -> str:
    p = Albers()
    n, c, rho0 = p.constants
    e2, e = p.e2, math.sqrt(p.e2)
    return f"""WITH p AS (SELECT c_custkey, (c_custkey % 60) - 15.0 AS lon, (c_custkey % 50) - 20.0 AS lat FROM customer), s AS (SELECT *, sin(radians(lat)) AS s FROM p),
    q AS (SELECT *, {1 - e2!r} * (s / (1 - {e2!r} * s * s) - ln((1 - {e!r} * s) / (1 + {e!r} * s)) / {2 * e!r}) AS q, {n!r} * radians(lon - 25.0) AS t FROM s),
    r AS (SELECT *, 6378137.0 * sqrt({c!r} - {n!r} * q) / {n!r} AS rho FROM q)
    SELECT c_custkey, round(rho * sin(t) + 1e-7, 2) AS x, round({rho0!r} - rho * cos(t) + 1e-7, 2) AS y FROM r"""


def _lonlat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 60) - 15.0).alias("lon"), ((F.col("c_custkey") % 50) - 20.0).alias("lat"))


@query("albers_forward", _albers_sql())
def albers(spark: SparkSession, sf: str) -> DataFrame:
    x, y = Albers().forward(F.col("lon"), F.col("lat"))
    return rounded(_lonlat(spark, sf).select("c_custkey", x.alias("x"), y.alias("y")), "x", "y", to=2)


@query("albers_round_trip", "SELECT c_custkey, (c_custkey % 60) - 15.0 AS lon, (c_custkey % 50) - 20.0 AS lat FROM customer")
def albers_back(spark: SparkSession, sf: str) -> DataFrame:
    x, y = Albers().forward(F.col("lon"), F.col("lat"))
    there = _lonlat(spark, sf).select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = Albers().inverse(F.col("x"), F.col("y"))
    return rounded(there.select("c_custkey", lon.alias("lon"), lat.alias("lat")), "lon", "lat", to=5)


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of 3 to 7 units around 45 by 45 places, many of which overlap or touch."""
    side, x, y = F.expr("CAST(3 + s_suppkey % 5 AS DOUBLE)"), F.expr("CAST(s_suppkey * 7 % 40 AS DOUBLE)"), F.expr("CAST(s_suppkey * 13 % 41 AS DOUBLE)")
    corner = lambda i, j: F.struct((x + i * side).alias("x"), (y + j * side).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return table(spark, sf, "supplier").select("s_nationkey", F.array(F.array(ring)).alias("geom"))


_SITES = """s AS (SELECT s_nationkey, s_suppkey * 7 % 40 AS x, s_suppkey * 13 % 41 AS y, 3 + s_suppkey % 5 AS side FROM supplier)"""


@query(
    "dissolve",
    f"""WITH {_SITES}, cx AS (SELECT *, unnest(range(x, x + side)) AS i FROM s), cells AS (SELECT DISTINCT s_nationkey, i, unnest(range(y, y + side)) AS j FROM cx)
    SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS area FROM cells GROUP BY 1""",
)
def dissolve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.dissolved(_sites(spark, sf), by=("s_nationkey",)).select("s_nationkey", geo.area("geom").alias("area")), "area")


@query(
    "dissolved_members",
    f"""WITH {_SITES}, p AS (SELECT c_custkey, c_nationkey, c_custkey % 97 * 0.5 + 0.25 AS x, c_custkey % 89 * 0.53 + 0.125 AS y FROM customer)
    SELECT c_custkey FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s_nationkey = 0 AND p.x BETWEEN s.x AND s.x + side AND p.y BETWEEN s.y AND s.y + side)""",
)
def dissolved_members(spark: SparkSession, sf: str) -> DataFrame:
    at = table(spark, sf, "customer").selectExpr("c_custkey", "CAST(c_custkey % 97 * 0.5 + 0.25 AS DOUBLE) AS x", "CAST(c_custkey % 89 * 0.53 + 0.125 AS DOUBLE) AS y")
    whole = spatial.dissolved(_sites(spark, sf).where("s_nationkey = 0"))
    return spatial.clip_points(at, whole, point_key="c_custkey", size=20.0).select("c_custkey")


@query("simplify", "SELECT n_nationkey, CASE WHEN 2 * (n_nationkey % 7 + 4) / sqrt(10) > 4.5 THEN 9 ELSE 5 END AS vertices FROM nation")
def simplify(spark: SparkSession, sf: str) -> DataFrame:
    """Every second corner is far from the line between its neighbours; the others are by 2 / sqrt(10) of the size."""
    found = spatial.simplified(polygons(spark, sf), 4.5)
    return found.select("n_nationkey", F.size(F.flatten(F.flatten("geom"))).alias("vertices"))
