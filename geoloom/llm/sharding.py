"""Sharding into parts of near equal size by sampled splitters."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import splitters
from .common import Scratch, need


def shard_by_bytes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    ranges: int = 2048,
    samples_per_range: int = 16,
    overfull: float = 4.0,
    seed: int = 11,
) -> DataFrame:
    """Put every row into one of ``shards`` parts whose sizes are near equal (the ``bytes`` law).

    Rows are ordered by (MD5 of the text, id). Boundaries come from a size-weighted sample of keys (at most
    ``ranges * samples_per_range`` expected); ranges that turn out to hold more than ``overfull`` times their share
    are sampled again and subdivided, by id where they hold copies of one text. Exact sums per range then give each
    row its place in the whole order, and equal places make equal shards.

    Equal texts share a shard unless they weigh more than 1/1024 of all bytes; such a group is dealt row by row.
    A row's size is its UTF-8 length plus 1. Returns id, size, text_crc32, law, shard, slot (gapless from 0 in each
    shard) and grown_shard (null: the law has no such promise).

    Null text: size 1, checksum 0, ordered as the empty text. Null ids come first. Repeated rows are all kept. Empty
    input gives an empty result. Further columns are ignored.
    """
    need(docs, id_col, text_col)
    spark, work = docs.sparkSession, Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = work.table(
        docs.select(
            F.col(id_col).cast("bigint").alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("crc"),
            F.md5(F.encode(text, "utf-8")).alias("key"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    hot = _heavy_groups(rows, total) if total else []
    cuts, sums = _fitted(rows, total, ranges, samples_per_range, overfull, seed)

    def spread(values: list[int], kind: str = "array<bigint>"):
        return F.from_json(F.lit(json.dumps(values)), kind)

    count = len(cuts) + 1
    bytes_before = [0, *accumulate(sums.get(r, (0, 0))[0] for r in range(count))]
    rows_before = [0, *accumulate(sums.get(r, (0, 0))[1] for r in range(count))]
    order = Window.partitionBy("range").orderBy("key", F.col("id").asc_nulls_first())
    group = Window.partitionBy("range", "key")
    alone = F.col("key").isin(hot) if hot else F.lit(False)
    placed = (
        rows.withColumn("range", splitters.range_of(cuts, F.col("key"), F.col("id")))
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(order))
        .withColumn("from", F.get(spread(bytes_before), F.col("range")) + F.col("upto") - F.col("size"))
        .withColumn("first", F.when(alone, F.col("from")).otherwise(F.min("from").over(group)))
        .withColumn("weight", F.when(alone, F.col("size")).otherwise(F.sum("size").over(group)))
        .withColumn("shard", F.expr(f"least({shards - 1}, ((2 * first + weight) * {shards}) div {max(2 * total, 1)})").cast("int"))
        .withColumn("place", F.get(spread(rows_before), F.col("range")) + F.col("nth") - 1)
    )
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    begins = [0, *accumulate(held.get(s, 0) for s in range(shards))]
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.get(spread(begins), F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _heavy_groups(rows: DataFrame, total: int) -> list[str]:
    """Keys that weigh more than 1/1024 of the whole: fewer than 1024 of them, by that bound."""
    found = rows.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [r["key"] for r in found.where((F.col("n") > 1) & (F.col("b") * 1024 > total)).collect()]


def _fitted(rows: DataFrame, total: int, ranges: int, per_range: int, overfull: float, seed: int):
    """Boundaries, and bytes and rows of each range that isn't empty (at most a few times ``ranges`` numbers)."""
    if not total:
        return [], {}
    cuts = splitters.quantiles(splitters.draw(rows, "key", "id", "size", ranges * per_range / total, seed), ranges)
    for again in range(4):
        dealt = rows.withColumn("range", splitters.range_of(cuts, F.col("key"), F.col("id")))
        one = F.struct("key", "id")
        found = dealt.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), (F.min(one) != F.max(one)).alias("many"), F.max("size").alias("most")).collect()
        sums = {r["range"]: (r["b"], r["n"]) for r in found}
        full = [r for r in found if r["many"] and r["b"] > max(overfull * total / ranges, 2 * r["most"])]
        if not full or again == 3:
            return cuts, sums
        inside = dealt.where(F.col("range").isin([r["range"] for r in full]))
        bytes_in = sum(r["b"] for r in full)
        parts = min(ranges, sum(-(-r["b"] * ranges // total) for r in full))
        sample = splitters.draw(inside, "key", "id", "size", parts * per_range / bytes_in, seed + 1 + again)
        more = splitters.quantiles(sample, parts)
        cuts = splitters.tidy([*cuts, *more, *(c for c, _ in sample[:: max(1, per_range // 2)] if _copies(c, cuts))])
    raise AssertionError("not reached")


def _copies(cut, cuts) -> bool:
    """The key already is a boundary: what overfills the range is copies of one text, cut by id."""
    return any(k == cut[0] for k, _ in cuts)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
