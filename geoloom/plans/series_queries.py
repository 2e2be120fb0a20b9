"""Queries of the series, observation and column-function operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, features, names
from ..operators import models, nearest, observations, series
from .tables import LATTICE, NEAREST, TARGETS, grid, lattice, line_sql, rounded, table, targets

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_ZONES = 'SELECT r AS "row", c AS col, user_id % 20 AS zone_id FROM lattice'


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    return lattice(spark, sf).select("row", "col", (F.col("user_id") % 20).alias("zone_id"))


@query("zonal_mean", f"WITH {LATTICE} SELECT user_id % 20 AS zone_id, round(avg(v) + 1e-7, 4) AS mean, count(v) AS n FROM lattice GROUP BY 1")
def zonal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.zonal_mean(lattice(spark, sf).select("row", "col", "v"), _zones(spark, sf)), "mean")


def _daily(spark: SparkSession, sf: str, scale: float = 0.0001) -> DataFrame:
    stack = lattice(spark, sf).select(F.to_date("ts").alias("date"), "row", "col", "v")
    return series.zonal_daily_means(stack, _zones(spark, sf), scale=scale)


@query("zonal_daily_mean", f"WITH {LATTICE} SELECT CAST(ts AS DATE) AS date, user_id % 20 AS zone_id, round(avg(v) + 1e-7, 4) AS value FROM lattice GROUP BY 1, 2")
def zonal_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily(spark, sf, 1.0), "value")


@query(
    "zonal_pivot",
    f"""WITH {LATTICE} SELECT CAST(ts AS DATE) AS date, {", ".join(f'round(avg(CASE WHEN user_id % 20 = {z} THEN v END) + 1e-7, 4) AS z{z}' for z in range(20))}
    FROM lattice GROUP BY 1""",
)
def zonal_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = series.wide_series(_daily(spark, sf, 1.0), list(range(20)))
    return rounded(wide.select("date", *[F.col(str(z)).alias(f"z{z}") for z in range(20)]), *[f"z{z}" for z in range(20)])


@query(
    "unpivot_series",
    f"""WITH {LATTICE}, w AS (SELECT CAST(ts AS DATE) AS date, user_id % 20 AS z, round(avg(v) + 1e-7, 4) AS value FROM lattice GROUP BY 1, 2),
    d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM lattice) SELECT d.date, 'z' || k AS zone_id, value FROM d CROSS JOIN (SELECT unnest(range(0, 20)) AS k) LEFT JOIN w ON w.date = d.date AND w.z = k""",
)
def unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return series.long_series(zonal_pivot(spark, sf), [f"z{z}" for z in range(20)])


@query(
    "temporal_stats",
    f"""WITH {LATTICE} SELECT user_id, round(min(v) + 1e-7, 4) AS min, round(max(v) + 1e-7, 4) AS max, round(avg(v) + 1e-7, 4) AS mean, round(stddev_pop(v) + 1e-7, 4) AS std,
    round(sum(v) + 1e-7, 4) AS sum, {", ".join(f"round(quantile_cont(v, {q / 100}) + 1e-7, 4) AS q{q}" for q in (10, 25, 50, 75, 90))} FROM lattice GROUP BY user_id""",
)
def temporal_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.cell_statistics(lattice(spark, sf), by=("user_id",)), "min", "max", "mean", "std", "sum", "q10", "q25", "q50", "q75", "q90")


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(start.alias("date_start"), F.date_add(start, 15).alias("date_end"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"))


@query(
    "interval_expand_last_wins",
    """WITH i AS (SELECT CAST(o_orderdate AS DATE) AS s, 'f' || o_orderkey AS file FROM orders),
    d AS (SELECT CAST(unnest(range(CAST(s AS TIMESTAMP), CAST(s AS TIMESTAMP) + INTERVAL 16 DAY, INTERVAL 1 DAY)) AS DATE) AS date, s, file FROM i),
    n AS (SELECT date, file, row_number() OVER (PARTITION BY date ORDER BY s DESC, file DESC) AS nth FROM d) SELECT date, file FROM n WHERE nth = 1""",
)
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return series.expand_intervals(_intervals(spark, sf))


@query(
    "calendar_spine",
    """WITH n AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(d AS DATE) AS date, n FROM (SELECT unnest(range(TIMESTAMP '1994-12-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY)) AS d) s LEFT JOIN n ON n.date = CAST(d AS DATE)""",
)
def spine(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    return series.on_calendar(days, series.calendar(spark, "1994-12-01", "2001-12-31"))


@query(
    "tile_index_wide",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date_start, 'h' || (o_orderkey % 3) AS tile, min('f' || o_orderkey) AS file FROM orders GROUP BY 1, 2)
    SELECT date_start, date_start + 15 AS date_end, max(CASE WHEN tile = 'h0' THEN file END) AS h0, max(CASE WHEN tile = 'h1' THEN file END) AS h1,
    max(CASE WHEN tile = 'h2' THEN file END) AS h2, CAST(count(*) AS INT) AS ntiles FROM c GROUP BY 1""",
)
def tiles_wide(spark: SparkSession, sf: str) -> DataFrame:
    tile = F.concat(F.lit("h"), (F.substring("file", 2, 20).cast("bigint") % 3).cast("string"))
    return series.tiles_wide(_intervals(spark, sf).withColumn("tile", tile), ["h0", "h1", "h2"])


@query(
    "trailing_mean_60d",
    """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 10 AS zone_id, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
    p AS (SELECT o_orderkey, o_custkey % 10 AS zone_id, CAST(o_orderdate AS DATE) AS e FROM orders)
    SELECT o_orderkey, round(avg(value) + 1e-7, 2) AS mean, count(value) AS n_days FROM p LEFT JOIN d ON d.zone_id = p.zone_id AND d.date BETWEEN e - 60 AND e GROUP BY 1""",
)
def trailing(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 10).alias("zone_id")).agg(F.avg("l_extendedprice").alias("value"))
    points = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("zone_id"), F.to_date("o_orderdate").alias("e"))
    points = points.withColumn("s", dates.period_start("e"))
    return rounded(series.trailing_means(points, daily, point_key="o_orderkey", start="s", end="e"), "mean", to=2)


@query(
    "series_per_zone",
    f"""WITH {LATTICE}, d AS (SELECT user_id % 20 AS zone_id, CAST(ts AS DATE) AS date, round(avg(v) + 1e-7, 4) AS value FROM lattice GROUP BY 1, 2)
    SELECT zone_id, count(*) AS days, string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS dates FROM d GROUP BY 1""",
)
def collected(spark: SparkSession, sf: str) -> DataFrame:
    found = series.collected(_daily(spark, sf))
    return found.select("zone_id", F.size("series").cast("bigint").alias("days"), F.array_join(F.transform("series", lambda x: x["date"].cast("string")), ",").alias("dates"))


@query("decade_hist", "SELECT CAST(least(year(o_orderdate) // 10 * 10, 2010) AS INT) AS decade, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1950 AND 2020 GROUP BY 1")
def decades(spark: SparkSession, sf: str) -> DataFrame:
    return series.decade_histogram(table(spark, sf, "orders"), date="o_orderdate")


_NOTATIONS = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN '00:00:00' ELSE '' END"""


@query(
    "normalize_dates",
    f"""WITH t AS (SELECT o_orderkey, {_NOTATIONS} AS text FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_full_match(text, '\\d{{4}}') THEN make_date(CAST(text AS INT), 1, 1)
      WHEN regexp_full_match(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+.*') THEN CAST(substr(text, 1, 10) AS DATE)
      WHEN regexp_full_match(text, '\\d{{2}}/\\d{{2}}/\\d{{2}}') THEN make_date(CAST(substr(text, 7, 2) AS INT) + CASE WHEN CAST(substr(text, 7, 2) AS INT) <= 25 THEN 2000 ELSE 1900 END,
        CAST(substr(text, 4, 2) AS INT), CAST(substr(text, 1, 2) AS INT))
      WHEN regexp_full_match(text, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN make_date(CAST(substr(text, 7, 4) AS INT), CAST(substr(text, 4, 2) AS INT), CAST(substr(text, 1, 2) AS INT)) END AS date FROM t""",
)
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(d, "dd/MM/yy"))
    text = text.when(k == 3, F.date_format(d, "dd/MM/yyyy")).when(k == 4, F.lit("00:00:00")).otherwise(F.lit(""))
    return table(spark, sf, "orders").select("o_orderkey", dates.normalize_date(text).alias("date"))


_RECHARGE = "CASE WHEN a < 100 THEN 30 WHEN a < 500 THEN 60 WHEN a < 1000 THEN 90 WHEN a < 3000 THEN 120 WHEN a < 5000 THEN 150 WHEN a < 10000 THEN 180 ELSE 360 END"


@query("recharge_period", f"SELECT p_partkey, {_RECHARGE} AS days, DATE '2020-06-30' - {_RECHARGE} AS start FROM (SELECT p_partkey, CASE WHEN p_size <> 13 THEN p_size * p_size * 5.0 END AS a FROM part)")
def recharge(spark: SparkSession, sf: str) -> DataFrame:
    area = F.when(F.col("p_size") != 13, F.col("p_size") * F.col("p_size") * 5.0)
    day = F.lit("2020-06-30").cast("date")
    return table(spark, sf, "part").select("p_partkey", dates.recharge_days(area).alias("days"), dates.period_start(day, period="by_area", area_km2=area).alias("start"))


@query("year_window", "SELECT o_orderkey FROM orders WHERE year(CAST(o_orderdate AS DATE) - 60) > 1996 AND year(o_orderdate) < 2000")
def year_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("DATE")).withColumn("climdata_date_start", dates.period_start("DATE"))
    return observations.in_years(rows, after=1996, before=2000).select("o_orderkey")


@query("date_in_name", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def date_in_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("https://host/prec."), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(".tif"))
    return table(spark, sf, "orders").select("o_orderkey", dates.date_in_name(name).alias("date"))


@query(
    "name_templates",
    """SELECT lat, lon, 'NASADEM_HGT_' || CASE WHEN lat < 0 THEN 's' ELSE 'n' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lon < 0 THEN 'w' ELSE 'e' END
      || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '.zip' AS zip, format('slope_tile_{:03d}_{:03d}.tif', lat + 40, lon + 40) AS tile, 'h' || (lon + 40) || 'v' || (lat + 40) AS hv
    FROM (SELECT unnest(range(-5, 6)) AS lat), (SELECT unnest(range(-20, 21)) AS lon)""",
)
def templates(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.range(11 * 41).select((F.expr("id div 41") - 5).alias("lat"), (F.col("id") % 41 - 20).alias("lon"))
    tile = names.layer_tile_name(F.lit("slope"), F.col("lat") + 40, F.col("lon") + 40)
    return cells.select("lat", "lon", names.elevation_tile_name(F.col("lat"), F.col("lon")).alias("zip"), tile.alias("tile"), names.sinusoidal_tile_name(F.col("lon") + 40, F.col("lat") + 40).alias("hv"))


@query("parse_lists", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT) AS first, CAST(l_partkey AS INT) AS second FROM lineitem")
def parse_lists(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(", "), F.col("l_partkey").cast("string"), F.lit(")"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", names.parse_int_list(text).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(names.page_links("html")).alias("link"))


_LIST = "(VALUES ('BUILDING', 3), ('MACHINERY', 5), ('BUILDING', 8)) AS l(seg, k)"


def _listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("BUILDING", 3), ("MACHINERY", 5), ("BUILDING", 8)], "c_mktsegment string, k bigint")


@query("bad_list_pairs", f"SELECT c_custkey, c_mktsegment, c_custkey % 11 AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_LIST} WHERE seg = c_mktsegment AND l.k = c_custkey % 11)")
def bad_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 11).alias("k"))
    return observations.without_listed(rows, _listed(spark), group="c_mktsegment", key="k").select("c_custkey", "c_mktsegment", "k")


@query("bad_list_cross", "SELECT c_custkey, c_mktsegment, c_custkey % 11 AS k FROM customer WHERE NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 11 IN (3, 5, 8))")
def bad_cross(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 11).alias("k"))
    return observations.without_listed(rows, _listed(spark), group="c_mktsegment", key="k", mode="cross").select("c_custkey", "c_mktsegment", "k")


@query("union_tagged", "SELECT n_name AS name, CAST(n_regionkey AS INT) AS n_regionkey, 'nation' AS part FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def union(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return observations.union_tagged({"nation": nation.select(F.col("n_name").alias("name"), "n_regionkey"), "region": region.select(F.col("r_name").alias("name"))}, "part")


@query("outer_align_dropna", "SELECT c_nationkey AS key, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("suppliers"))
    return observations.aligned(c, s, key="key")


@query("range_split", "SELECT CASE WHEN c_acctbal < 1000 THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM customer GROUP BY 1")
def split(spark: SparkSession, sf: str) -> DataFrame:
    below, above = models.hold_out(table(spark, sf, "customer"), "c_acctbal", 1000)
    return observations.union_tagged({"test": below, "train": above}, "side").groupBy("side").agg(F.count("*").alias("n"))


@query("recode_alias", "SELECT n_nationkey, CASE n_name WHEN 'IRAN' THEN 'Persia' WHEN 'CHINA' THEN 'Cathay' ELSE n_name END AS name FROM nation")
def recode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", features.recode(F.col("n_name"), {"IRAN": "Persia", "CHINA": "Cathay"}).alias("name"))


@query(
    "derived_ratios",
    f"""WITH {TARGETS}, {NEAREST}, f AS (SELECT l.r, l.c, l.v AS z, zt.value AS zs, 30 * sqrt(d2) AS ds, 40.0 - l.c AS dc, CASE WHEN l.c % 9 <> 0 THEN 30.0 * abs(l.c - 40) END AS dr
      FROM near n JOIN lattice l ON l.r = n.r AND l.c = n.c JOIN lattice zt ON zt.r = tr AND zt.c = tc)
    SELECT r AS "row", c AS col, round(ds + 1e-7, 4) AS dist_stream, round(dr + 1e-7, 4) AS dist_top, round(CASE WHEN dr IS NOT NULL THEN ds / greatest(dr, 30) END + 1e-7, 4) AS ratio_dist,
      round(z - zs + 1e-7, 4) AS alt_stream, round(CASE WHEN dr IS NOT NULL THEN 500 - z END + 1e-7, 4) AS alt_top, round((z - zs) / greatest(ds, 30) + 1e-7, 4) AS ratio_stream FROM f""",
)
def derived(spark: SparkSession, sf: str) -> DataFrame:
    cells = lattice(spark, sf)
    g = grid(cells)
    near = nearest.nearest_feature(cells, targets(cells), g, value="value").join(cells.select("row", "col", "v"), ["row", "col"])
    px, py = g.centre(F.col("row"), F.col("col"))
    known = F.col("col") % 9 != 0
    rx = F.when(known, g.centre(F.col("row"), F.lit(40))[0])
    rows = near.withColumns({"px": px, "py": py, "rx": rx, "ry": F.when(known, py), "rz": F.when(known, F.lit(500.0))})
    found = features.derived(("px", "py", "v"), ("x", "y", "z"), ("rx", "ry", "rz"))
    return rounded(rows.withColumns(found).select("row", "col", *found), *found)


@query(
    "prototype_ratios",
    """SELECT l_orderkey, l_linenumber, round((z - 5) / (60 - z + 0.1) + 1e-7, 4) AS ratio_alt, round((d + 30) / 130.0 + 1e-7, 4) AS ratio_dist, round((z - 5) / (d + 30) + 1e-7, 4) AS ratio_stream,
    round((60 - z) / 130.0 + 1e-7, 4) AS ratio_top FROM (SELECT l_orderkey, l_linenumber, l_quantity AS z, l_discount * 1000 AS d FROM lineitem)""",
)
def prototype(spark: SparkSession, sf: str) -> DataFrame:
    found = features.prototype_ratios(F.col("l_quantity"), F.lit(5.0), F.lit(60.0), F.col("l_discount") * 1000, F.lit(100.0))
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in found.items()]), *found)


@query(
    "feature_table",
    f"""WITH {TARGETS}, {NEAREST}, p AS (SELECT c_custkey, 1000.0 + (c_custkey % 100) * 30.0 + 15 AS x, 50000.0 - (c_custkey % 10) * 30.0 - 15 AS y,
      CAST(c_custkey % 10 AS INT) AS r, CAST(c_custkey % 100 AS INT) AS c FROM customer),
    s AS (SELECT p.*, l.v AS z, 1000.0 + (tc + 0.5) * 30 AS stream_x, 50000.0 - (tr + 0.5) * 30 AS stream_y, g.value AS stream_z
      FROM p JOIN lattice l ON l.r = p.r AND l.c = p.c JOIN near n ON n.r = p.r AND n.c = p.c JOIN lattice g ON g.r = tr AND g.c = tc),
    f AS (SELECT c_custkey, CASE WHEN count(l.v) >= 4 THEN avg(l.v) END AS short_mean FROM p JOIN lattice l ON l.r BETWEEN p.r - 3 AND p.r + 3 AND l.c BETWEEN p.c - 3 AND p.c + 3 GROUP BY 1),
    ends AS (SELECT DISTINCT n.r AS r0, n.c AS c0, tr AS r1, tc AS c1 FROM near n JOIN p ON n.r = p.r AND n.c = p.c), {line_sql("ends")},
    t AS (SELECT r0, c0, CASE WHEN count(l.v) >= 4 THEN avg(l.v) END AS stream_mean FROM line LEFT JOIN lattice l ON l.r = lr AND l.c = lc GROUP BY 1, 2),
    d AS (SELECT s.*, short_mean, stream_mean, sqrt((x - stream_x) ** 2 + (y - stream_y) ** 2) AS dist_stream, z - stream_z AS alt_stream
      FROM s JOIN f ON f.c_custkey = s.c_custkey JOIN t ON t.r0 = s.r AND t.c0 = s.c)
    SELECT c_custkey, x, y, r AS "row", c AS col, {", ".join(f"round({k} + 1e-7, 4) AS {k}" for k in ("z", "short_mean", "stream_mean", "stream_x", "stream_y", "stream_z", "dist_stream", "alt_stream"))},
      round(alt_stream / greatest(dist_stream, 30) + 1e-7, 4) AS ratio_stream FROM d WHERE z IS NOT NULL AND short_mean IS NOT NULL AND stream_mean IS NOT NULL AND stream_z IS NOT NULL""",
)
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Observation points with sampled focal and path statistics, nearest coordinates and ratios, complete rows only."""
    from ..operators import focal, lines, spatial

    cells = lattice(spark, sf).select("row", "col", "v", "value", "event_type")
    g = grid(cells)
    obs = table(spark, sf, "customer").select("c_custkey", (F.lit(1000.0) + (F.col("c_custkey") % 100) * 30.0 + 15).alias("x"), (F.lit(50000.0) - (F.col("c_custkey") % 10) * 30.0 - 15).alias("y"))
    row, col = g.cell(F.col("x"), F.col("y"))
    near = nearest.nearest_feature(cells, targets(cells), g, value="value")
    near = near.join(obs.select(row.alias("row"), col.alias("col")).distinct(), ["row", "col"], "left_semi")  # only points have paths
    paths = near.select(F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("t_row").alias("row1"), F.col("t_col").alias("col1"))
    grad = lines.path_stats(paths, cells).select(F.col("row0").alias("row"), F.col("col0").alias("col"), F.col("mean").alias("v"))
    small = focal.square_stats(cells, 7).select("row", "col", F.col("mean").alias("v"))
    layers = {"z": cells.select("row", "col", "v"), "short_mean": small, "stream_mean": grad}
    layers |= {f"stream_{k}": near.select("row", "col", F.col(k).alias("v")) for k in ("x", "y", "z")}
    out = spatial.sample_points(obs, layers, g, key="c_custkey")
    dist = features.distance(F.col("x"), F.col("y"), F.col("stream_x"), F.col("stream_y"))
    out = out.withColumns({"dist_stream": dist, "alt_stream": F.col("z") - F.col("stream_z")})
    out = out.withColumn("ratio_stream", features.floored_ratio(F.col("alt_stream"), F.col("dist_stream"))).na.drop(how="any")
    return rounded(out, *[c for c in out.columns if c not in ("c_custkey", "x", "y", "row", "col")])


@query(
    "error_by_class",
    """SELECT l_returnflag, count(*) AS n, round(avg(d) + 1e-7, 4) AS mean_error, round(sqrt(avg(d * d)) + 1e-7, 4) AS rmse, round(sqrt(avg(d * d)) / avg(l_extendedprice) * 100 + 1e-7, 4) AS rmse_pct,
    round(corr(l_extendedprice, p) + 1e-7, 4) AS corr FROM (SELECT *, l_quantity * 1500.0 AS p, l_extendedprice - l_quantity * 1500.0 AS d FROM lineitem) GROUP BY 1""",
)
def errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("prediction", F.col("l_quantity") * 1500.0)
    return rounded(models.errors(rows, label="l_extendedprice", by=("l_returnflag",)), "mean_error", "rmse", "rmse_pct", "corr")


@query(
    "top_k_features",
    "SELECT p_brand AS feature, CAST(round_even(avg(p_retailprice) / 1000 * 100, 1) AS DOUBLE) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    folds = table(spark, sf, "part").select(F.col("p_brand").alias("feature"), (F.col("p_retailprice") / 1000).alias("importance"))
    return models.average_importance(folds).limit(10)


@query(
    "standardize",
    "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) + 1e-7, 4) AS c_acctbal FROM customer",
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.standardized(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal")


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 200).cast("double").alias("k"), F.length("p_name").cast("double").alias("n"))


@query("logo_cv_forest")
def forest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).withColumn("group", F.substring("p_brand", 1, 7))
    return models.cross_validate(rows, ["size", "k", "n"], label="p_retailprice", group="group", numTrees=10, maxDepth=6)[0]


@query("gbt_cv")
def boosted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).withColumn("group", F.substring("p_brand", 1, 7))
    return models.cross_validate(rows, ["size", "k", "n"], label="p_retailprice", group="group", kind="boosted", maxIter=5, maxDepth=3)[0]


@query("random_search")
def search(spark: SparkSession, sf: str) -> DataFrame:
    settings = {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [2, 4]}
    return models.random_search(_model_rows(spark, sf), ["size", "k", "n"], label="p_retailprice", grid=settings, n=3, folds=2)


@query("feature_subsets", "SELECT size, CAST(count(*) AS BIGINT) AS n FROM (SELECT bit_count(m) AS size FROM (SELECT unnest(range(0, 256)) AS m)) WHERE size >= 6 GROUP BY 1")
def subsets(spark: SparkSession, sf: str) -> DataFrame:
    return models.feature_subsets(spark, [f"f{k}" for k in range(8)]).groupBy("size").agg(F.count("*").alias("n"))


@query("subset_search")
def subset_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).withColumn("group", F.substring("p_brand", 1, 7))
    return models.subset_search(rows, ["size", "k", "n"], label="p_retailprice", group="group", least=2, numTrees=5, maxDepth=4)


@query(
    "gridded_month_box",
    f"""WITH {LATTICE} SELECT strftime(ts, '%Y-%m-%d') AS date, r AS lat, c AS lon, CASE WHEN v <> 0.5 THEN v END AS v FROM lattice
    WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' AND r > 1 AND r < 7 AND c > 10 AND c < 60""",
)
def gridded(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.readers import gridded_month

    stack = lattice(spark, sf).select(F.to_date("ts").alias("date"), F.col("row").alias("lat"), F.col("col").alias("lon"), "v")
    return gridded_month(stack, 2024, 1, (1, 7, 10, 60), nodata=0.5).withColumn("date", F.col("date").cast("string"))


@query("pending_work", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderdate < TIMESTAMP_NTZ '1995-06-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey"))
    return observations.not_done(table(spark, sf, "customer").select("c_custkey"), done, key="c_custkey")


@query("basins_with_points", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def with_points(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return observations.basins_with_points(table(spark, sf, "nation").select("n_nationkey", "n_name"), points, key="n_nationkey")


@query("complete_rows", f'WITH {LATTICE} SELECT r AS "row", c AS col, v FROM lattice WHERE v IS NOT NULL')
def complete(spark: SparkSession, sf: str) -> DataFrame:
    return lattice(spark, sf).select("row", "col", "v").na.drop(how="any")


@query("days_with_any_value", f"""WITH {LATTICE}, w AS (SELECT CAST(ts AS DATE) AS date, avg(CASE WHEN event_type = 'view' THEN v END) AS a, avg(CASE WHEN event_type = 'error' THEN v END) AS b FROM lattice GROUP BY 1)
    SELECT date, round(a + 1e-7, 4) AS view, round(b + 1e-7, 4) AS error FROM w WHERE a IS NOT NULL OR b IS NOT NULL""")
def any_value(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("v"))).alias(kind)
    days = lattice(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(mean("view"), mean("error"))
    return rounded(days.na.drop(how="all", subset=["view", "error"]), "view", "error")


@query("zonal_daily_scaled", f"WITH {LATTICE} SELECT CAST(ts AS DATE) AS date, user_id % 20 AS zone_id, round(avg(v) * 0.0001 + 1e-9, 6) AS value FROM lattice GROUP BY 1, 2")
def zonal_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("clamped", "SELECT c_custkey, greatest(least(c_acctbal, 5000), 0) AS v FROM customer")
def clamped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", features.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("v"))
