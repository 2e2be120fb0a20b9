"""Tokens per section: whole documents are encoded once and token spans are joined to section spans."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

RULES = ("most", "first", "last")
_RUN = re.compile(r"\S{2000}|\s{2000}")


@cache
def byte_bpe(folder: str) -> ByteBpe:
    return ByteBpe(folder)


class ByteBpe:
    """Byte-level vocabulary: a text's tokens, joined, are its very bytes, so lengths of tokens give their spans."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
        self.slow.encode_special_tokens = True
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if _RUN.search(text):  # the fast encoder's time grows with the square of an unbroken run
            return np.array(self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each token, in bytes of the text."""
        size = self.size[self.ids(text)] if text else np.zeros(0, np.int64)
        end = np.cumsum(size)
        return end - size, end


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each line in characters; a line holds the newline that ends it, so lines tile the text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    sizes[-1] -= 1
    if not sizes[-1]:  # the text ends with a newline
        sizes = sizes[:-1]
    end = np.cumsum(sizes)
    return end - sizes, end


def to_bytes(text: str, places: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    if text.isascii():
        return places
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.r_[0, np.cumsum(width)][places]


def attribute(begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and crossing tokens of each section, and tokens in none.

    Both spans are sorted, and sections don't overlap, so the join is two searches a token. A token that lies in several
    sections is counted once: with ``most``, where most of its bytes are (of equals the earlier); with ``first`` or
    ``last``, in the first or last section that it touches. ``crossing`` counts the tokens that a section was given and
    that also lie in another.
    """
    n = len(first)
    lo = np.searchsorted(last, begin, side="right")  # first section that ends behind the token's begin
    hi = np.searchsorted(first, end, side="left") - 1  # last section that begins before the token's end
    inside = hi >= lo
    outside = int((~inside).sum())
    crossing = inside & (hi > lo)
    to = (hi if rule == "last" else lo)[inside].copy()
    if rule == "most" and crossing.any():
        chosen = lo.copy()
        for t in np.flatnonzero(crossing):
            k = np.arange(lo[t], hi[t] + 1)
            chosen[t] = k[np.argmax(np.minimum(last[k], end[t]) - np.maximum(first[k], begin[t]))]
        to = chosen[inside]
    return np.bincount(to, minlength=n), np.bincount(to[crossing[inside]], minlength=n), outside


def token_counts(
    docs: DataFrame,
    folder: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "most",
) -> DataFrame:
    """One row per section: id, section (its number), start, end (characters), n_tokens and n_crossing.

    Sections are the lines of the text, or those of ``sections_col``: an array of structs (start, end), sorted and apart.
    Tokens in no section are counted in a row with section -1 (start 0, end the text's length), which is there only if
    there are any. So a document's counts add up to its tokens. Null and empty texts have no rows; with sections of
    zero length, those get no tokens. Null ids and repeated rows are counted like any other. ``folder`` holds the
    vocabulary files on the executors; further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    need(docs, id_col, text_col, *([sections_col] if sections_col else []))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = byte_bpe(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                spans = part.column("sections").to_pylist() if sections_col else [None] * part.num_rows
                for k, (text, given) in enumerate(zip(part.column("text").to_pylist(), spans, strict=True)):
                    if not text:
                        continue
                    begin, end = vocabulary.spans(text)
                    if sections_col:
                        first = np.array([s["start"] for s in given or ()], np.int64)
                        last = np.array([s["end"] for s in given or ()], np.int64)
                    else:
                        first, last = line_sections(text)
                    tokens, crossing, outside = attribute(begin, end, to_bytes(text, first), to_bytes(text, last), rule)
                    number = np.arange(len(first))
                    if outside:
                        number, first, last = np.r_[number, -1], np.r_[first, 0], np.r_[last, len(text)]
                        tokens, crossing = np.r_[tokens, outside], np.r_[crossing, 0]
                    for to, found in zip(out, (np.full(len(number), k), number, first, last, tokens, crossing), strict=True):
                        to.append(found)
                if out[0]:
                    which, number, first, last, tokens, crossing = (np.concatenate(x).astype(np.int64) for x in out)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(which)), pa.array(number.astype(np.int32)), *(pa.array(x) for x in (first, last, tokens, crossing))],
                        ["id", "section", "start", "end", "n_tokens", "n_crossing"],
                    )

    picked = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).alias("text"),
        *([F.col(sections_col).cast("array<struct<start:bigint,end:bigint>>").alias("sections")] if sections_col else []),
    )
    found = picked.mapInArrow(rows, "id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint")
    return found.withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
