"""Best-fit packing of tokenised documents into sequences, in a tree of merges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, need
from .tokens import word_bpe

_FIELDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "crc": pa.int64()}
_BIN = "part int, settled boolean, fill int, doc_id array<bigint>, piece array<int>, start array<bigint>, length array<int>, crc array<bigint>, offset array<int>"


def pieces_of(ids: bytes, limit: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32 of the ids) of one document; only documents beyond ``limit`` are cut."""
    step = 4 * limit
    return [(k, k * limit, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Items (largest first) into bins of ``limit``: each goes to the bin that it leaves least room in.

    Open bins are kept by their room, and the set of rooms as the bits of one number, so that an item costs a few
    operations whatever the number of bins.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            here = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[here].append(item)
        else:
            room, here = limit, len(bins)
            bins.append([item])
        by_room[room - size].append(here)
        if room - size:
            rooms |= 1 << (room - size)
    return bins


def _merge(held: pa.Table, part: int, limit: int, slack: int, carry: int, last: bool) -> pa.Table:
    """Underfull bins (rows) as items of one more best-fit round; the emptiest ``carry`` of the results stay open."""
    sizes = held.column("fill").to_numpy()
    bins = best_fit(sizes, limit)
    fill = np.array([sizes[b].sum() for b in bins], np.int32)
    open_bins = np.zeros(len(bins), bool)
    if not last:
        under = np.flatnonzero(fill < limit - slack)
        open_bins[under[np.argsort(fill[under], kind="stable")][:carry]] = True
    order = pa.array(np.concatenate([np.array(b, np.int64) for b in bins]) if bins else np.array([], np.int64))
    lists = held.select(list(_FIELDS)).take(order)
    ends = np.cumsum([len(b) for b in bins])
    columns: dict = {"part": pa.array(np.full(len(bins), part, np.int32)), "settled": pa.array(~open_bins), "fill": pa.array(fill)}
    for name in _FIELDS:
        column = lists.column(name).combine_chunks()
        inner = np.r_[0, np.cumsum(column.value_lengths().to_numpy())]  # each bin's list is its items' lists in a row
        columns[name] = pa.ListArray.from_arrays(pa.array(inner[np.r_[0, ends].astype(np.int64)].astype(np.int32)), column.flatten())
    sizes = columns["length"].flatten().to_numpy()
    upto = np.cumsum(sizes, dtype=np.int64) - sizes  # ahead of an item, less what is ahead of its bin
    ahead = np.repeat(np.r_[0, np.cumsum(fill[:-1], dtype=np.int64)], np.diff(columns["length"].offsets.to_numpy())) if len(fill) else upto
    columns["offset"] = pa.ListArray.from_arrays(columns["length"].offsets, pa.array((upto - ahead).astype(np.int32)))
    return pa.table(columns)


def packed(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    slack: int = 8,
    fan_in: int = 8,
    carry: int = 512,
    end_id: int = 0,
    local: int = 1 << 16,
    work: Scratch | None = None,
) -> DataFrame:
    """Sequences of at most ``limit`` tokens: sequence_id, fill, and arrays doc_id, piece, start, length, crc, offset.

    Every partition tokenises its documents and packs each ``local`` pieces best-fit; bins with at most ``slack`` free
    tokens are settled. The others become items of the next round, in which ``fan_in`` parts meet, up to a single part.
    A part hands on at most ``carry`` open bins, the emptiest, and settles the rest: that bounds what any task holds
    and loses no piece. ``tokenizer`` is the path of a vocabulary file on the executors.
    """
    need(docs, id_col, text_col)
    work = work or Scratch(docs.sparkSession, "packing")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, end = word_bpe(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        items: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            one = np.arange(len(items) + 1, dtype=np.int32)
            columns = dict(zip(_FIELDS, zip(*items, strict=True), strict=True)) if items else {n: () for n in _FIELDS}
            table = {"fill": pa.array(columns["length"], pa.int32())}
            table |= {n: pa.ListArray.from_arrays(pa.array(one), pa.array(columns[n], t)) for n, t in _FIELDS.items()}
            items.clear()
            yield from _merge(pa.table(table), part, limit, slack, carry, False).to_batches(max_chunksize=4096)

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at in range(0, len(ids), 256):
                texts = batch.column("text").slice(at, 256).to_pylist()
                for doc, found in zip(ids[at : at + 256], vocabulary.ids_of(texts), strict=True):
                    items.extend((doc, *p) for p in pieces_of(found + end, limit))
                if len(items) >= local:
                    yield from close()
        yield from close()

    def again(last: bool):
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            return _merge(table, key[0].as_py(), limit, slack, carry, last)

        return merge

    start = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    now = work.table(start.mapInArrow(first, _BIN), "round0")
    done = now.where("settled")
    parts, k = (now.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        k, parts = k + 1, -(-parts // fan_in)
        rest = now.where("NOT settled").withColumn("part", F.expr(f"part div {fan_in}").cast("int"))
        now = work.table(rest.groupBy("part").applyInArrow(again(parts == 1), _BIN), f"round{k}")
        done = done.unionByName(now.where("settled"))
        if parts == 1:
            break
    return done.withColumn("sequence_id", F.monotonically_increasing_id()).drop("part", "settled")


def pack_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (its place in the sequence).

    Null text counts as empty: such a document is the end id alone. Null ids, repeated rows and very long texts are
    packed like any other; empty input gives an empty result; further columns are ignored.
    """
    bins = packed(docs, tokenizer, id_col=id_col, **options)
    each = bins.select("sequence_id", F.explode(F.arrays_zip("doc_id", "piece", "start", "length", "crc", "offset")).alias("p"))
    return each.select(
        F.col("p.doc_id").alias(id_col), "p.piece", "p.start", F.col("p.length").cast("bigint").alias("length"),
        F.col("p.crc").alias("ids_crc32"), "sequence_id", F.col("p.offset").cast("bigint").alias("offset"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
