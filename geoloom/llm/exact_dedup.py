"""Exact deduplication by a distributed sort of the normalised content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import splitters
from .common import SPACE, Scratch, need, unit_hash


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = 6 << 20,
    min_ranges: int = 64,
    max_ranges: int = 1 << 16,
    samples_per_range: int = 12,
    seed: int = 23,
) -> DataFrame:
    """Groups of texts that are equal once white space (0x20, 0x09-0x0D) is deleted, and the row of each that stays.

    Sampled, size-weighted splitters range-partition the normalised bytes; each range is sorted (externally, with
    spill) so that equal texts are neighbours, and neighbours are compared in full. The splitters' key is the first 32
    bytes and a 64-bit hash of the content, then the id: a group that would overfill a range is cut by id, and the
    pieces of such groups (fewer than there are ranges) are put together again afterwards.

    The row with the most code points in its original text stays, then the smallest id (null ids last; of rows that
    are equal in both, exactly one). Null text counts as empty. Returns one row per input row: id, keep_id, group_size,
    kept, text_sha256 (of the normalised text). Empty input gives an empty result; further columns are ignored.
    """
    need(docs, id_col, text_col)
    work = Scratch(docs.sparkSession, "dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    total = source.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = max(min_ranges, min(max_ranges, total // range_bytes))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("norm", F.regexp_replace("text", f"[{SPACE}]+", "")).withColumn(
            "key", F.concat(F.rpad(F.hex(F.substring(F.encode("norm", "utf-8"), 1, 32)), 64, "."), F.hex(F.xxhash64("norm")))
        )

    cuts: list[splitters.Splitter] = []
    if total:
        rate = ranges * samples_per_range / total
        weighed = source.withColumn("weight", (F.octet_length("text") + 1).cast("bigint"))
        picked = keyed(weighed.where(unit_hash("id", "weight", seed=seed) < F.col("weight") * rate))
        sample = [((r[0], r[1]), max(float(r[2]), 1 / rate)) for r in picked.select("key", "id", "weight").collect()]
        cuts = splitters.quantiles(sample, ranges)
    split = sorted({k for k, i in cuts if i is not None})  # groups that lie in several ranges

    order = Window.partitionBy("range").orderBy("norm", "id")
    run = Window.partitionBy("range", "run")
    best = run.orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
    sorted_rows = (
        keyed(source)
        .select(
            "id",
            F.char_length("text").alias("chars"),
            "norm",
            F.sha2(F.encode("norm", "utf-8"), 256).alias("sha"),
            splitters.range_of(cuts, F.col("key"), F.col("id")).alias("range"),
            (F.col("key").isin(split) if split else F.lit(False)).alias("cut"),
        )
        .withColumn("new", F.coalesce(F.lag("norm").over(order) != F.col("norm"), F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    rows = (
        sorted_rows.select("id", "chars", "sha", "range", "cut", "run")
        .withColumn("nth", F.row_number().over(best))
        .withColumn("keep", F.first("id").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("n", F.count("*").over(run))
    )
    if split:
        rows = work.table(rows, "runs")
        rank = F.struct(F.col("chars"), F.bitwise_not("id").alias("id"), (-F.col("range")).alias("range"))
        pieces = rows.where(F.col("cut") & (F.col("nth") == 1))  # one row for each range that a cut group lies in
        whole = pieces.groupBy("sha").agg(
            F.sum("n").alias("all_n"), F.max_by("keep", rank).alias("all_keep"), F.max_by("range", rank).alias("all_range")
        )  # at most as many rows as there are splitters
        rows = (
            rows.join(F.broadcast(whole), "sha", "left")
            .withColumn("nth", F.when(F.col("cut") & (F.col("range") != F.col("all_range")), F.lit(0)).otherwise(F.col("nth")))
            .withColumn("keep", F.when(F.col("cut"), F.col("all_keep")).otherwise(F.col("keep")))
            .withColumn("n", F.when(F.col("cut"), F.col("all_n")).otherwise(F.col("n")))
        )
    return rows.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("nth") == 1).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
