"""The driver's tables as the engine's relations, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid

WIDTH = 100
STATS = ("min", "max", "mean", "var", "skew", "kurt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dense raster: row, col, v (NULL for errors), and the event's columns."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr(f"cast(event_id div {WIDTH} AS int)").alias("row"),
        F.expr(f"cast(event_id % {WIDTH} AS int)").alias("col"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
        "event_type", "value", "user_id", "ts",
    )


def grid(cells: DataFrame, pixel: float = 30.0) -> Grid:
    height = (cells.agg(F.max("row")).first()[0] or 0) + 1
    return Grid(pixel, 1000.0, -pixel, 50000.0, WIDTH, height, "demo")


def targets(cells: DataFrame) -> DataFrame:
    return cells.where((F.col("event_type") == "error") & (F.col("value") > 100)).select("row", "col")


def barriers(cells: DataFrame) -> DataFrame:
    return cells.where((F.col("event_type") == "signup") & (F.col("value") > 250)).select("row", "col")


LATTICE = f"""lattice AS (
  SELECT CAST(event_id // {WIDTH} AS INT) AS r, CAST(event_id % {WIDTH} AS INT) AS c,
         CASE WHEN event_type <> 'error' THEN value END AS v, event_type, value, user_id, ts
  FROM events)"""
TARGETS = LATTICE + ", targets AS (SELECT r, c FROM lattice WHERE event_type = 'error' AND value > 100)"
BARRIERS = TARGETS + ", barriers AS (SELECT r, c FROM lattice WHERE event_type = 'signup' AND value > 250)"


def rounded(df: DataFrame, *columns: str, to: int = 4) -> DataFrame:
    """Columns rounded for comparison. The table's values have two decimals, so means often end on a half: the nudge
    decides such ties alike everywhere."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + 1e-7, to) + F.lit(0.0) for c in columns})


def moments_sql(source: str, keys: str, null_if: str = "false") -> str:
    """Six-moment summary of the rows (keys, v) of the relation ``source``, written out as central moments."""
    on = " AND ".join(f"s.{k} = g.{k}" for k in keys.split(", "))
    picked = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""g AS (SELECT {keys}, count(v) AS n, avg(v) AS m, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY {keys}),
    mm AS (SELECT {picked}, any_value(n) AS n, any_value(m) AS m, any_value(lo) AS lo, any_value(hi) AS hi,
                  avg((v - m) * (v - m)) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4
           FROM {source} s JOIN g ON {on} GROUP BY {picked}),
    st AS (SELECT *, CASE WHEN lo <> hi THEN m3 / m2 ** 1.5 END AS sk FROM mm),
    stats AS (SELECT {keys},
         CASE WHEN n >= 4 AND NOT ({null_if}) THEN round(lo + 1e-7, 4) END AS min, CASE WHEN n >= 4 AND NOT ({null_if}) THEN round(hi + 1e-7, 4) END AS max,
         CASE WHEN n >= 4 AND NOT ({null_if}) THEN round(m + 1e-7, 4) END AS mean,
         CASE WHEN n >= 4 AND NOT ({null_if}) THEN round(CASE WHEN lo = hi THEN 0 ELSE m2 END + 1e-7, 4) END AS var,
         CASE WHEN n >= 4 AND NOT ({null_if}) THEN round(sk + 1e-7, 4) + 0.0 END AS skew,
         CASE WHEN n >= 4 AND NOT ({null_if}) AND lo <> hi THEN round(greatest(m4 / (m2 * m2), sk * sk + 1) + 1e-7, 4) END AS kurt
       FROM st)"""


def line_sql(pairs: str, keys: str = "") -> str:
    """Cells of the lines of a relation (keys, r0, c0, r1, c1)."""
    k = f"{keys}, " if keys else ""
    return f"""ext AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n, least(abs(r1 - r0), abs(c1 - c0)) AS m FROM {pairs}),
    steps AS (SELECT *, unnest(range(0, n + 1)) AS k FROM ext),
    minor AS (SELECT *, CASE WHEN n > 0 THEN (2 * k * m + n - 1) // (2 * n) ELSE 0 END AS o FROM steps),
    line AS (SELECT {k}r0, c0, r1, c1, k AS step,
      r0 + (CASE WHEN r1 > r0 THEN 1 ELSE -1 END) * (CASE WHEN abs(r1 - r0) > abs(c1 - c0) THEN k ELSE o END) AS lr,
      c0 + (CASE WHEN c1 > c0 THEN 1 ELSE -1 END) * (CASE WHEN abs(r1 - r0) > abs(c1 - c0) THEN o ELSE k END) AS lc
      FROM minor)"""


NEAREST = """near AS (
  SELECT r, c, tr, tc, d2 FROM (
    SELECT l.r, l.c, t.r AS tr, t.c AS tc, (l.r - t.r) * (l.r - t.r) + (l.c - t.c) * (l.c - t.c) AS d2,
           row_number() OVER (PARTITION BY l.r, l.c ORDER BY (l.r - t.r) * (l.r - t.r) + (l.c - t.c) * (l.c - t.c), t.r, t.c) AS nth
    FROM lattice l CROSS JOIN targets t) WHERE nth = 1)"""
