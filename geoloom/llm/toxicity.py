"""Toxicity by gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import Scratch, need, unit_hash

#: A small general list of insults, per language; the labelled texts add to it what their words show.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool imbecile jerk bastard "
    "bitch asshole retard freak creep pig vermin filth "
    "idiotin dummkopf trottel arschloch schwein abschaum dreckig wertlos erbärmlich blödmann "
    "idiote imbécile crétin connard salaud ordure pathétique débile minable "
    "idiota estúpido imbécil tonto basura patético asqueroso payaso cabrón escoria".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"(?<![^\W_])(?=\S{3,24}(?:\s|$))[^\W\d_]+(?:[0-9@$*!|._-]+[^\W\d_]+)+")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._*-]){3,12}[^\W\d_](?![^\W_])")
FEATURES = (
    "lexicon_density lexicon_hits lexicon_best lexicon_sum negative_sum stem_density stem_hits stem_best insult_density insult_hits second_density "
    "near_second capitals shouted exclaim question punctuation symbols digits masked_rate masked_hits spelled log_words log_chars mean_word repeats"
).split()
_STEM = 6
_NEAR = 6


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lexicon:
    """Log-odds of words and of word beginnings, and the dense features that follow from them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], most: int = 300_000):
        self.words, self.stems, self.most = words, stems, most
        self.known: dict[str, tuple | None] = {}

    def _look(self, w: str) -> tuple | None:
        """(word weight, stem weight, insult, second person) or None for a word without any."""
        if len(self.known) >= self.most:
            self.known.clear()
        weight, stem = self.words.get(w, 0.0), self.stems.get(w[:_STEM], 0.0) if len(w) >= _STEM else 0.0
        found = (weight, stem, w in INSULTS, w in SECOND_PERSON)
        self.known[w] = found = found if any(found) else None
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = words_of(text)
        known, missing = self.known, object()
        n = max(len(words), 1)
        hits = stem_hits = insults = second = near = 0
        best = stem_best = total = negative = 0.0
        last_second = last_hit = -(10**9)
        for i, w in enumerate(words):
            found = known.get(w, missing)
            if found is None:
                continue
            if found is missing:
                found = self._look(w)
                if found is None:
                    continue
            weight, stem, insult, you = found
            hit = weight > 1.0 or insult
            if weight > 1.0:
                hits += 1
                total += weight
                best = max(best, weight)
            elif weight < -1.0:
                negative += weight
            if stem > 1.0:
                stem_hits += 1
                stem_best = max(stem_best, stem)
            insults += insult
            if you:
                second += 1
                near += i - last_hit <= _NEAR
                last_second = i
            if hit:
                near += i - last_second <= _NEAR
                last_hit = i
        counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        letters = max(int(counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()), 1)
        chars = max(len(text), 1)
        masked = [m.translate(_LEET).replace("*", "").replace(".", "").replace("-", "").replace("_", "").lower() for m in _MASKED.findall(text)]
        masked_hits = sum(m in INSULTS or self.words.get(m, 0.0) > 2.0 for m in masked)
        spelled = [re.sub(r"[ ._*-]", "", m).lower() for m in _SPELLED.findall(text)]
        spelled_hits = sum(any(x in m for x in INSULTS if len(x) > 3) for m in spelled)
        code = lambda s: int(sum(counts[ord(c)] for c in s))
        return [
            100 * hits / n, hits, best, total, negative, 100 * stem_hits / n, stem_hits, stem_best, 100 * insults / n, insults, 100 * second / n,
            near, int(counts[65:91].sum()) / letters, _shouted(counts, letters),
            100 * int(counts[33]) / chars, 100 * int(counts[63]) / chars, 100 * code(".,;:'\"()") / chars, 100 * code("#*$%&|<>@^~=+") / chars,
            100 * int(counts[48:58].sum()) / chars, 100 * len(masked) / n, masked_hits, spelled_hits, math.log1p(len(words)), math.log1p(len(text)),
            sum(map(len, words)) / n, 1 - len(set(words)) / n,
        ]


def _shouted(counts: np.ndarray, letters: int) -> float:
    """1 if capitals outnumber small letters, which only shouted text shows."""
    return float(counts[65:91].sum() > counts[97:123].sum() and letters > 5)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 0


class Model:
    """A lexicon, trees and a calibration; small enough to be sent to every task (its lexicon is bounded)."""

    def __init__(self, lexicon: Lexicon, trees: Boosted, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.lexicon.features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return self.calibration(self.trees.margin(x))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 16_000,
    folds: int = 4,
    lexicon_size: int = 20_000,
    seed: int = 5,
    work: Scratch | None = None,
) -> Model:
    """Fit to a sample of about ``sample`` labelled rows (drawn by a hash of the id) outside the held-out ones.

    Word and word-beginning log-odds are counted in the cluster, at most ``lexicon_size`` of each are kept. A row's
    features for the trees use log-odds from the other ``folds`` only, so the trees see them as strong as they will be
    on new texts, and the calibration is fitted to margins of trees that haven't seen the row.
    """
    work = work or Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    count = known.count()
    drawn = known.where(unit_hash("id", seed=seed) < min(1.0, sample / max(count, 1)))
    drawn = drawn.withColumn("fold", F.floor(unit_hash("id", seed=seed + 1) * folds).cast("int"))
    drawn = work.table(drawn, "drawn")  # at most about ``sample`` rows, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = work.table(texts.join(F.broadcast(drawn), "id").dropDuplicates(["id"]), "texts")
    lexicons = _lexicons(rows, folds, lexicon_size)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Lexicon(*x) for x in lexicons]
        for batch in batches:
            found = [readers[f].features(t) for f, t in zip(batch["fold"], batch["text"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "fold": batch["fold"], "x": found})

    table = rows.mapInPandas(features, "id bigint, y int, fold int, x array<double>").orderBy("id").toPandas()
    x = np.array(table["x"].tolist(), np.float64).reshape(len(table), len(FEATURES))
    y, fold = table["y"].to_numpy(np.float64), table["fold"].to_numpy()
    margin = np.zeros(len(table))
    for f in range(folds):
        margin[fold == f] = Boosted().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(Lexicon(*lexicons[folds]), Boosted().fit(x, y), Isotonic().fit(margin, y))


def _terms(batches: Iterator[pd.DataFrame], at_once: int = 64) -> Iterator[pd.DataFrame]:
    """(kind, term, y, fold) for the distinct words and word beginnings of each row: hundreds a row, so ``at_once`` rows at a time."""
    for batch in batches:
        for start in range(0, len(batch), at_once):
            kind, term, y, fold = [], [], [], []
            part = batch.iloc[start : start + at_once]
            for text, label, f in zip(part["text"], part["y"], part["fold"], strict=True):
                seen = set(words_of(text))
                for k, group in enumerate((seen, {w[:_STEM] for w in seen if len(w) >= _STEM})):
                    kind.extend([k] * len(group))
                    term.extend(group)
                    y.extend([label] * len(group))
                    fold.extend([f] * len(group))
            yield pd.DataFrame({"kind": kind, "term": term, "y": y, "fold": fold})


def _lexicons(rows: DataFrame, folds: int, most: int) -> list[tuple[dict[str, float], dict[str, float]]]:
    """(words, stems) with their log-odds, without each fold in turn and last with all of them."""

    sums = [F.sum(F.when((F.col("y") == v) & (F.col("fold") == f), 1).otherwise(0)).alias(f"n{v}_{f}") for v in (0, 1) for f in range(folds)]
    pairs = [F.sum(F.when((F.col("y") == v) & (F.col("fold") == f), 1).otherwise(0)).alias(f"a{v}_{f}") for v in (0, 1) for f in range(folds)]
    all_rows = rows.agg(*pairs).first()
    total = {(v, f): all_rows[f"a{v}_{f}"] or 0 for v in (0, 1) for f in range(folds)}
    rate = (sum(total[1, f] for f in range(folds)) + 1) / (sum(total.values()) + 2)
    counted = rows.select("text", "y", "fold").mapInPandas(_terms, "kind int, term string, y int, fold int").groupBy("kind", "term").agg(*sums)
    toxic = sum((F.col(f"n1_{f}") for f in range(folds)), F.lit(0))
    clean = sum((F.col(f"n0_{f}") for f in range(folds)), F.lit(0))
    lift = F.abs(F.log((toxic + rate * 4) / (clean + (1 - rate) * 4) * ((1 - rate) / rate))) * F.sqrt(toxic + clean)
    counted = counted.where(toxic + clean >= 3).withColumn("lift", lift)
    frames = [counted.where(F.col("kind") == k).orderBy(F.col("lift").desc(), "term").limit(most).toPandas() for k in (0, 1)]  # bounded by ``most``
    out = []
    for left_out in [*range(folds), None]:
        both = []
        inside = [f for f in range(folds) if f != left_out]
        n1, n0 = sum(total[1, f] for f in inside) + 1, sum(total[0, f] for f in inside) + 1
        for frame in frames:
            t = frame[[f"n1_{f}" for f in inside]].sum(axis=1).to_numpy(float)
            c = frame[[f"n0_{f}" for f in inside]].sum(axis=1).to_numpy(float)
            share = n1 / (n1 + n0)
            odds = np.log((t + 2 * share) / n1) - np.log((c + 2 * (1 - share)) / n0)
            both.append({w: float(o) for w, o, k in zip(frame["term"], odds, t + c, strict=True) if abs(o) > 0.7 and k >= 2})
        out.append(tuple(both))
    return out


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores; only the text leaves the JVM. A column of that name in ``docs`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(list(batch)))

    return docs.withColumn(score_col, scores(F.coalesce(F.col(text_col), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted for every row.

    Features come from the text alone. Null text counts as empty and, like any other text, gets a score. Null ids count
    as held out. With no usable labels every score is the same. Repeated rows are all scored; an empty table gives an
    empty result; further columns are ignored.
    """
    need(docs, id_col, text_col)
    need(labels, id_col)
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    found = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).drop("text")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", predicted)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
