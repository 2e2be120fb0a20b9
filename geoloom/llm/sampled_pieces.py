"""Sampled subword segmentations: forward filtering and backward sampling over the lattice of pieces."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

SPACE = "▁"
_LITERAL = "\udfff"  # stands for the mark's own character in a text; no valid text holds a lone surrogate


@cache
def piece_lattice(path: str, temperature: float) -> PieceLattice:
    return PieceLattice(path, temperature)


class PieceLattice:
    """All ways to cut a text into pieces of a SentencePiece vocabulary, with probability by their weights.

    A piece weighs (its rank in the vocabulary + 2) ** (-1 / ``temperature``), frequent pieces ranking first; a
    segmentation weighs the product. A character without a piece goes by its UTF-8 bytes. Spaces are shown by a mark that
    begins a piece, so a text's lattice falls apart into one for each word with the marks before it. The distinct words
    of a call are filtered forward once, all together; each occurrence is sampled anew.
    """

    def __init__(self, path: str, temperature: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        ranks = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.trie: dict[str, tuple[int, float] | None] = {}
        for rank, i in enumerate(ranks):
            piece = model.id_to_piece(i)
            if SPACE not in piece.lstrip(SPACE) and "\n" not in piece:  # such a piece would reach over a cut
                for k in range(1, len(piece)):
                    self.trie.setdefault(piece[:k], None)
                self.trie[piece] = (i, (rank + 2) ** (-1 / temperature))
        self.byte_weight = (len(ranks) + 2) ** (-1 / temperature)
        # longest word that the joint forward pass takes: beyond it a product of weights might underflow
        self.longest = int(min(40, 250 / max(math.log10(1 / self.byte_weight), 1)))
        self._tables()

    def _tables(self) -> None:
        """The trie as arrays: a hash table from (state, character) to the next state, and each state's piece."""
        state = {"": 0} | {p: k + 1 for k, p in enumerate(self.trie)}
        self.piece = np.array([-1] + [v[0] if v else -1 for v in self.trie.values()], np.int32)
        self.weight = np.array([0.0] + [v[1] if v else 0.0 for v in self.trie.values()])
        keys = np.array([state[p[:-1]] << 21 | ord(p[-1]) for p in self.trie], np.int64)
        self.bits = 2 + int(len(keys)).bit_length()
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_next = np.full(1 << self.bits, -1, np.int32)
        for key, slot, k in zip(keys.tolist(), self._slot(keys).tolist(), range(1, len(keys) + 1), strict=True):
            while self.slot_key[slot] >= 0:
                slot = slot + 1 & (1 << self.bits) - 1
            self.slot_key[slot], self.slot_next[slot] = key, k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states, -1 where the trie ends."""
        keys = state.astype(np.int64) << 21 | char
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        look = np.arange(len(keys))
        while len(look):
            there = self.slot_key[slot[look]]
            hit = there == keys[look]
            out[look[hit]] = self.slot_next[slot[look[hit]]]
            look = look[~hit & (there >= 0)]
            slot[look] = slot[look] + 1 & (1 << self.bits) - 1
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattices of some words as one: chances, nodes before and ids of the choices (sorted by node), choices per
        node, and where each word's nodes begin. Long words, and those with characters outside the vocabulary, go singly."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        char = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        final = np.cumsum(size)[word]
        at, state = np.arange(len(char)), np.zeros(len(char), np.int32)
        single = size > self.longest
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        length = 0
        while len(at):
            length += 1
            inside = at + length <= final[at]
            at, state = at[inside], state[inside]
            state = self._step(state, char[at + length - 1])
            if length == 1:
                single[word[at[(state < 0) | (self.piece[state] < 0)]]] = True
                keep = ~single[word[at]]
                at, state = at[keep], state[keep]
            on = state >= 0
            at, state = at[on], state[on]
            ends = self.piece[state] >= 0
            found.append((at[ends], state[ends], length))
        found.reverse()  # a node's choices stand in order of where they begin
        alone = {k: self.word(words[k]) for k in np.flatnonzero(single).tolist()}
        nodes = size + 1
        for k, t in alone.items():
            nodes[k] = len(t[3]) >> 2
        begin = np.r_[0, np.cumsum(nodes)]
        place = np.arange(len(char)) - (np.cumsum(size) - size)[word]
        start = np.concatenate([begin[word[a]] + place[a] for a, _, _ in found])
        which = np.concatenate([s for _, s, _ in found])
        end = start + np.repeat([n for _, _, n in found], [len(a) for a, _, _ in found])
        into = np.concatenate([place[a] + n for a, _, n in found])
        order = np.argsort(end, kind="stable")
        start, which, end, into = start[order], which[order], end[order], into[order]
        weight = self.weight[which]
        forward = np.zeros(begin[-1])
        forward[begin[:-1]] = 1.0
        by_place = np.argsort(into, kind="stable")
        for sel in np.split(by_place, np.cumsum(np.bincount(into, minlength=1))[:-1]):
            if len(sel):
                new = np.flatnonzero(np.r_[True, np.diff(end[sel]) > 0])
                forward[end[sel[new]]] = np.add.reduceat(forward[start[sel]] * weight[sel], new)
        count = np.bincount(end, minlength=begin[-1])
        upto = np.cumsum(forward[start] * weight / forward[end])
        first = (np.cumsum(count) - count)[end]
        chance = upto - np.where(first > 0, upto[first - 1], 0.0)
        ids, before = self.piece[which], start
        if alone:
            pad = [(k, *(np.frombuffer(x, kind) for x, kind in zip(t, (np.float64, np.int32, np.int32, np.int32), strict=True))) for k, t in alone.items()]
            for k, _, _, _, c in pad:
                count[begin[k] : begin[k + 1]] = c
            owner = np.concatenate([end, *[np.repeat(begin[k] + np.arange(len(c)), c) for k, _, _, _, c in pad]])
            order = np.argsort(owner, kind="stable")
            chance = np.concatenate([chance, *[x[1] for x in pad]])[order]
            before = np.concatenate([before, *[x[2] + begin[x[0]] for x in pad]])[order]
            ids = np.concatenate([ids, *[x[3] for x in pad]])[order]
        return chance, before, ids, count, begin

    def word(self, word: str) -> tuple[bytes, bytes, bytes, bytes]:
        """A word's lattice: cumulative chances (doubles), nodes before, ids and number of choices per node (ints).

        A node is a place in the word, and a choice at a node is a piece that ends there. Forward sums are scaled at each
        node, the exponent kept apart, so that long words don't underflow.
        """
        trie, n = self.trie, len(word)
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, n + 1):
                found = trie.get(word[start:end], 0)
                if found:
                    ends[end].append((start, found[0], found[1]))
                elif found == 0:
                    break
        chance, before, ids, count = [], [], [], [0]
        node_of, node = [0], 0
        forward, power = [1.0], [0]
        for end in range(1, n + 1):
            options = ends[end]
            at = power[end - 1]
            total = 0.0
            sums = []
            inner = 0
            if not options or options[-1][0] != end - 1:
                char = SPACE if word[end - 1] == _LITERAL else word[end - 1]
                data = char.encode("utf-8", "replace")
                for k, b in enumerate(data[:-1]):  # nodes inside the character, each with one choice
                    chance.append(1.0)
                    before.append(node_of[end - 1] if k == 0 else node)
                    ids.append(self.byte_ids[b])
                    count.append(1)
                    node += 1
                inner = len(data)
                options = [*options, (-1, self.byte_ids[data[-1]], 0.0)]
            for start, _, weight in options:
                if start < 0:
                    total += forward[end - 1] * self.byte_weight**inner
                else:
                    total += math.ldexp(forward[start] * weight, power[start] - at)
                sums.append(total)
            last_inner = node
            node += 1
            for (start, i, _), s in zip(options, sums, strict=True):
                chance.append(s / total)
                before.append(node_of[start] if start >= 0 else (last_inner if inner > 1 else node_of[end - 1]))
                ids.append(i)
            count.append(len(options))
            node_of.append(node)
            mantissa, exponent = math.frexp(total)
            forward.append(mantissa)
            power.append(at + exponent)
        return array("d", chance).tobytes(), array("i", before).tobytes(), array("i", ids).tobytes(), array("i", count).tobytes()

    def sample(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """Ids of each text, drawn with its seed: the same text and seed give the same ids wherever they are drawn."""
        number: dict[str, int] = {}
        words: list[int] = []
        owner = []
        for text in texts:
            cut = split_words(text)
            words.extend([number.setdefault(w, len(number)) for w in cut])
            owner.append(len(cut))
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        chance, before, ids, count, nodes = self.lattice(list(number))
        first = np.cumsum(count) - count

        word = np.array(words)
        order = np.argsort(word, kind="stable")  # occurrences of a word together, for the sake of the processor's caches
        text_of = np.repeat(np.arange(len(texts)), owner)
        place = np.arange(len(word)) - np.repeat(np.cumsum(owner) - owner, owner)
        state = _mix(np.array([s % (1 << 64) for s in seeds], np.uint64)[text_of] ^ _mix(place.astype(np.uint64) + np.uint64(1)))[order]
        node, stop, live = nodes[word[order] + 1] - 1, nodes[word[order]], np.arange(len(word))
        length = np.zeros(len(word), np.int64)
        steps = []
        while len(live):
            state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
            u = (state >> np.uint64(11)).astype(np.float64) / (1 << 53)
            choice = first[node]
            last = choice + count[node] - 1
            over = np.flatnonzero((u >= chance[choice]) & (choice < last))
            while len(over):
                choice[over] += 1
                over = over[(u[over] >= chance[choice[over]]) & (choice[over] < last[over])]
            steps.append((live, ids[choice]))
            length[live] += 1
            node = before[choice]
            more = node > stop
            live, node, stop, state = live[more], node[more], stop[more], state[more]
        # pieces were drawn from the words' ends, so a word's k-th step is its k-th piece from behind
        by_place = np.empty(len(word), np.int64)
        by_place[order] = length
        end = np.cumsum(by_place)[order]
        out = np.empty(int(by_place.sum()), np.int32)
        for k, (live, found) in enumerate(steps):
            out[end[live] - 1 - k] = found
        ends = np.cumsum(np.bincount(text_of, by_place, len(texts)).astype(np.int64))
        return np.split(out, ends[:-1])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str) -> list[str]:
    """The text with a mark before it and in place of each space, cut before each run of marks and around newlines.

    No piece holds a newline, nor a mark but at its beginning, so no piece reaches over a cut.
    """
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, _LITERAL)
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        parts = line.split(" ")
        if k:
            out.append("\n")
            if parts[0]:
                out.append(parts[0])
            parts = parts[1:]
        if "" not in parts:
            out += [SPACE + p for p in parts]
            continue
        marks = ""
        for part in parts:
            marks += SPACE
            if part:
                out.append(marks + part)
                marks = ""
        if marks:
            out.append(marks)
    return out


class PieceDecoder:
    """Text of ids: pieces joined, byte pieces read as UTF-8, the first mark dropped and the others shown as spaces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.data = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]

    def __call__(self, ids) -> str:
        return b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")[1:]


@cache
def piece_decoder(path: str) -> PieceDecoder:
    return PieceDecoder(path)


def encode_pieces(
    docs: DataFrame,
    model: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    temperature: float = 1.0,
    seed: int = 0,
    chunk: int = 4 << 20,
) -> DataFrame:
    """id, ids (a sampled segmentation), n_pieces and lossless (the ids decode to the very text) for every row.

    A row's draw depends on ``seed``, its id and its text alone, not on partitions, batches or retries, so repeated rows
    have equal ids. Null and empty texts have no pieces. Null ids draw like id 0. About ``chunk`` characters are held at
    a time. ``model`` is the path of a vocabulary file on the executors. Further columns are ignored; an empty table
    gives an empty result.
    """
    need(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = piece_lattice(model, temperature), piece_decoder(model)
        for batch in batches:
            held: list[str] = []
            at = size = 0
            n = batch.num_rows
            column = batch.column("text")
            for k in range(n):
                text = column[k].as_py()
                held.append(text)
                size += len(text)
                if size >= chunk or k == n - 1:
                    part = batch.slice(at, len(held))
                    found = lattice.sample(held, part.column("seed").to_pylist())
                    lossless = [decoder(f.tolist()) == t for f, t in zip(found, held, strict=True)]
                    lengths = np.array([len(f) for f in found], np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(found), pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("id"), ids, pa.array(lengths), pa.array(lossless)], ["id", "ids", "n_pieces", "lossless"])
                    held, at, size = [], k + 1, 0

    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)))
    start = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("seed"))
    found = start.mapInArrow(rows, "id bigint, ids array<int>, n_pieces int, lossless boolean")
    return found.select(F.col("id").alias(id_col), "ids", "n_pieces", "lossless")


def decode_pieces(rows: DataFrame, model: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give a null text."""

    @F.udf("string", useArrow=True)
    def text(ids):
        return None if ids is None else piece_decoder(model)(ids)

    return rows.withColumn(text_col, text(F.col(ids_col)))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
