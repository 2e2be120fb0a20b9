"""SimHash fingerprints and near-duplicate groups found with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, need, small_side
from .components import connected_components

BITS = 64
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


# -- fingerprints ------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a whole text in UTF-8; 0 if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return _HASH(b" ".join(words))
    ones = np.zeros(BITS, np.int64)
    n = len(words) - words_per_shingle + 1
    for at in range(0, n, 1 << 14):
        part = words[at : at + (1 << 14) + words_per_shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words_per_shingle)), strict=False))
        hashes = np.fromiter(map(_HASH, shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            found = np.array([fingerprint(text[k].as_py(), words_per_shingle) for k in range(len(text))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text).mapInArrow(rows, "id bigint, fp bigint")


# -- the index ---------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order, in which neighbours differ by one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order under a tree of masked bit patterns.

    A node's pattern holds the bits in which all codes below it agree and that its parent does not hold already. A
    search carries the differences met so far from parent to child and gives up a whole node once there are too many.
    """

    FAN = 16

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        both, either, common = [self.codes], [self.codes], [np.full(len(codes), ~np.uint64(0))]
        while len(both[-1]) > self.FAN:
            starts = np.arange(0, len(both[-1]), self.FAN)
            both.append(np.bitwise_and.reduceat(both[-1], starts))
            either.append(np.bitwise_or.reduceat(either[-1], starts))
            common.append(~(both[-1] ^ either[-1]))
        self.pattern = both
        self.own = [c if k + 1 == len(common) else c & ~np.repeat(common[k + 1], self.FAN)[: len(c)] for k, c in enumerate(common)]

    def within(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the code in ``codes``) of all pairs that differ in at most ``bits`` bits."""
        top = len(self.pattern) - 1
        q = np.repeat(np.arange(len(queries)), len(self.pattern[top]))
        node = np.tile(np.arange(len(self.pattern[top])), len(queries))
        gone = np.zeros(len(q), np.uint8)
        for level in range(top, -1, -1):
            gone = gone + np.bitwise_count((queries[q] ^ self.pattern[level][node]) & self.own[level][node])
            stay = gone <= bits
            q, node, gone = q[stay], node[stay], gone[stay]
            if level:
                q, gone = np.repeat(q, self.FAN), np.repeat(gone, self.FAN)
                node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                real = node < len(self.pattern[level - 1])
                q, node, gone = q[real], node[real], gone[real]
        return q, node


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] for all i, smaller roots on top; afterwards every node points at its root."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _forest(node: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among codes of equal node (rows sorted by node): (row, row of its tree's root)."""
    n = len(code)
    root = np.arange(n)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= GrayIndex.FAN, sizes)
    at, mine, theirs = np.flatnonzero(small), [], []
    for gap in range(1, GrayIndex.FAN):
        i = at[at + gap < n]
        i = i[(node[i] == node[i + gap]) & (np.bitwise_count(code[i] ^ code[i + gap]) <= bits)]
        mine.append(i)
        theirs.append(i + gap)
    hook(root, np.concatenate(mine), np.concatenate(theirs))
    for start, size in zip(starts[sizes > GrayIndex.FAN], sizes[sizes > GrayIndex.FAN], strict=True):
        index = GrayIndex(code[start : start + size])
        back = np.argsort(code[start : start + size])
        rows = start + back[np.searchsorted(code[start : start + size][back], index.codes)]
        step = max(16, (1 << 21) // size)
        for k in range(0, size, step):
            q, found = index.within(index.codes[k : k + step], bits)
            hook(root, rows[q + k], rows[found])
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _search(bits: int):
    """Partition function over rows (mask, pattern, code, rep) in the order of (mask, pattern)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy() for c in ("mask", "pattern", "code", "rep")])
            if not part.shape[1]:
                continue
            held.append(part)
            last = (part[:2] == part[:2, -1:]).all(axis=0)
            if last.all() or sum(p.shape[1] for p in held) < 1 << 15:
                continue  # the last node of the batch may go on in the next one
            held[-1] = part[:, ~last]
            yield links(np.concatenate(held, axis=1))
            held = [part[:, last]]
        if held:
            yield links(np.concatenate(held, axis=1))

    def links(part: np.ndarray) -> pa.RecordBatch:
        node = np.cumsum(np.r_[0, (part[:2, 1:] != part[:2, :-1]).any(axis=0)])
        a, b = _forest(node, part[2].view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(part[3][a]), pa.array(part[3][b])], ["a", "b"])

    return rows


def _parts(bits: list[int], pieces: int) -> list[int]:
    """The bits dealt into ``pieces`` masks of near equal size, each as a signed 64-bit number."""
    cuts = [round(len(bits) * k / pieces) for k in range(pieces + 1)]
    masks = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks if m]


def _below(mask: int, pieces: int) -> list[int]:
    """Masks one level down: all bits of ``mask`` and one of ``pieces`` parts of the others."""
    have = mask % (1 << BITS)
    down = [(have | m % (1 << BITS)) for m in _parts([b for b in range(BITS) if not have >> b & 1], pieces)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in down]


def near_links(codes: DataFrame, work: Scratch, *, bits: int = 2, full: int = 20_000) -> DataFrame:
    """Links (a, b) between the ids of codes that differ in at most ``bits`` bits; ``codes`` has distinct code, rep.

    The index's upper nodes are masked bit patterns: the 64 bits are dealt into ``bits + 1`` masks, and two codes within
    reach agree in at least one of them wholly, so each code goes to that many upper nodes and no pair is lost. A node
    with more than ``full`` codes is factored again by parts of its other bits, for the same reason without loss, until
    nodes are small or bits run out. Below, each node's codes lie in Gray order under a pruned tree. A node gives a
    spanning forest of its links, never all pairs.
    """
    masks, done = _parts(list(range(BITS)), bits + 1), None
    level = codes.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])))
    level = level.withColumn("pattern", F.expr("code & mask"))
    for depth in range(4):
        level = work.table(level, f"nodes{depth}")
        heavy = level.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > full).select("mask", "pattern")
        heavy = work.table(heavy, f"heavy{depth}")
        if depth == 3 or heavy.isEmpty():
            done = level if done is None else done.unionByName(level)
            break
        light = level.join(heavy, ["mask", "pattern"], "left_anti")
        done = light if done is None else done.unionByName(light)
        down = [(m, d) for m in masks for d in _below(m, bits + 1)]
        masks = sorted({d for _, d in down})
        lower = codes.sparkSession.createDataFrame(down, "mask bigint, down bigint")
        level = (
            level.join(heavy, ["mask", "pattern"], "left_semi")
            .join(F.broadcast(lower), "mask")
            .select("code", "rep", F.col("down").alias("mask"), F.expr("code & down").alias("pattern"))
        )
    together = done.select("mask", "pattern", "code", "rep").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return together.mapInArrow(_search(bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    bits: int = 2,
    full: int = 20_000,
    work: Scratch | None = None,
) -> DataFrame:
    """Fingerprint and group of every row: groups are joined by chains of fingerprints ``bits`` or fewer bits apart.

    Returns id, fingerprint (16 lowercase hexadecimal digits), component_id (the smallest id of the group). Equal
    fingerprints are one node of the index, whatever the number of their rows. Null text counts as empty: a text
    without words has fingerprint zero and is linked like any other. Rows with a null id make no links of their own and
    share the group of their fingerprint (null if it has no other row). Repeated rows are all kept; empty input gives
    an empty result; further columns are ignored.
    """
    need(docs, id_col, text_col)
    work = work or Scratch(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle), "fingerprints")
    codes = work.table(rows.groupBy(F.col("fp").alias("code")).agg(F.min("id").alias("rep")), "codes")
    links = near_links(codes.where("rep IS NOT NULL"), work, bits=bits, full=full)
    roots = connected_components(links, work)
    named = codes.join(roots, codes["rep"] == roots["node"], "left").select("code", F.coalesce("root", "rep").alias("component_id"))
    return rows.join(named, rows["fp"] == named["code"]).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", work: Scratch | None = None, **options) -> DataFrame:
    """The row with the smallest id of each group of near copies, with all columns of ``docs``.

    Of rows that share that id one stays. Rows without an id take no part: one of each text stays.
    """
    work = work or Scratch(docs.sparkSession, "simhash")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, work=work, **options)
    chosen = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("__keep")).agg(F.count("*").alias("__n"))
    chosen = work.table(chosen, "chosen")
    kept = docs.join(small_side(chosen), F.col(id_col) == F.col("__keep"))
    if not chosen.where("__n > 1").isEmpty():
        kept = kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates([id_col]))
    kept = kept.select(*docs.columns)
    nameless = docs.where(F.col(id_col).isNull())
    return kept if nameless.isEmpty() else kept.unionByName(nameless.dropDuplicates([text_col]))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
