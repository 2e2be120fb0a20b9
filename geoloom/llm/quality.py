"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, need, small_side

#: Names of the transformed statistics, in the order of the vectors.
VECTOR = ("x0", "x1", "x2", "x3", "x4")
_P = len(VECTOR)
#: Smallest standard deviation that a transformed statistic counts with: differences below it are no sign of junk.
FLOOR = (0.6, 0.12, 0.25, 0.25, 0.25)
#: Bins of a squared distance, per doubling; the subset of a C-step ends at a bin's border.
_PER_DOUBLING = 16


# -- statistics --------------------------------------------------------------------------------------------------


def with_stats(docs: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs), named with ``prefix``.

    Everything is computed within the row, so nothing is shuffled and no key can be hot. Words are ``[^ \\t-\\r]+``.
    Null text has no words and zeros throughout.
    """
    p = f"__q_{prefix}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")
    seq = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    width = 8
    df = docs.withColumn(p + "words", F.when(F.length(trimmed) > 0, F.split(trimmed, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(p + "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn(p + "hashes", F.transform(p + "words", lambda w: F.xxhash64(w)))
    df = df.withColumn(p + "n", F.size(p + "words"))
    df = df.withColumn(
        p + "windows", F.transform(seq(F.col(p + "n") - width), lambda i: F.xxhash64(*[F.get(p + "hashes", i + k) for k in range(width)]))
    )
    twice = F.size(F.array_distinct(p + "windows")) < F.size(p + "windows")
    at_sorted = F.array_sort(F.transform(p + "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(p + "sorted", F.when(twice, at_sorted))
    s, last = F.col(p + "sorted"), F.size(p + "sorted") - 1
    equal = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    again = F.filter(seq(last), lambda i: equal(i, i + 1) | F.when(i > 0, equal(i, i - 1)).otherwise(F.lit(False)))
    df = df.withColumn(p + "places", F.when(s.isNotNull(), F.array_sort(F.transform(again, lambda i: F.get(s, i)["i"]))))
    start = F.struct(F.lit(0).cast("bigint").alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate(
        p + "places",
        start,
        lambda acc, i: F.struct((acc["covered"] + (i + width) - F.greatest(acc["end"], i)).alias("covered"), (i + width).alias("end")),
        lambda acc: acc["covered"],
    )
    return df.withColumns(
        {
            prefix + "n_words": F.col(p + "n").cast("bigint"),
            prefix + "word_chars": F.char_length(F.array_join(p + "words", "")).cast("bigint"),
            prefix + "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
            prefix + "n_dup_lines": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("bigint"),
            prefix + "n_lines": F.size(p + "lines").cast("bigint"),
            prefix + "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        }
    ).drop(*[p + c for c in ("words", "lines", "hashes", "n", "windows", "sorted", "places")])


def vector(prefix: str = "") -> list[Column]:
    """The transformed statistics: log length, log mean word length, and asinh or root of three rates."""
    c = lambda name: F.col(prefix + name).cast("double")
    words, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return [
        F.log(words),
        F.log(F.greatest(c("word_chars"), F.lit(1.0)) / words),
        F.asinh(c("n_symbols") * 20 / words),
        F.sqrt(c("n_dup_lines") / lines) * 2,
        F.sqrt(c("n_repeat_words") / words) * 2,
    ]


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))


# -- chi-squared constants ---------------------------------------------------------------------------------------


def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function of (k / 2, x / 2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


# -- minimum covariance determinant ------------------------------------------------------------------------------


#: Centres that concentration begins from: the medians, and points one scale off them, by coordinate.
STARTS = [[0.0] * 5, [1.0] * 5, [-1.0] * 5, [1.0, -1.0, 1.0, -1.0, 1.0], [-1.0, 1.0, -1.0, 1.0, -1.0]]


def _z(params: str = "") -> list[Column]:
    """The whitened vector, by forward substitution with the Cholesky factor in columns l_ij and the centre m_i."""
    z: list[Column] = []
    for i in range(_P):
        rest = reduce(lambda s, j: s - F.col(f"{params}l_{i}{j}") * z[j], range(i), F.col(VECTOR[i]) - F.col(f"{params}m_{i}"))
        z.append(rest / F.col(f"{params}l_{i}{i}"))
    return z


def squared_distance() -> Column:
    return reduce(lambda a, b: a + b, [v * v for v in _z()])


def _cholesky(df: DataFrame) -> DataFrame:
    """Columns l_ij from covariance columns c_ij (j <= i)."""
    for i in range(_P):
        for j in range(i + 1):
            dot = reduce(lambda s, k: s - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}"), range(j), F.col(f"c_{i}{j}"))
            df = df.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(dot, F.lit(1e-9))) if i == j else dot / F.col(f"l_{j}{j}"))
    return df


def _param_names() -> list[str]:
    return [f"m_{i}" for i in range(_P)] + [f"l_{i}{j}" for i in range(_P) for j in range(i + 1)]


def _starts(rows: DataFrame, work: Scratch) -> DataFrame:
    """First centres and scales: medians and median deviations, from counts per bin of 1/64 (exact to a bin), and the
    centres that ``STARTS`` moves by such deviations.

    Rows are counted per (group, coordinate, bin) before the shuffle, so that a group of any size sends a bounded number
    of counts.
    """

    def medians(df: DataFrame) -> DataFrame:
        bins = df.select("g", F.posexplode(F.array(*VECTOR)).alias("i", "x")).groupBy("g", "i", F.floor(F.col("x") * 64).alias("bin")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("g", "i")
        upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = bins.select("g", "i", "bin", upto.alias("upto"), F.sum("n").over(w).alias("all")).where("2 * upto >= all")
        found = found.groupBy("g", "i").agg(((F.min("bin") + 0.5) / 64).alias("v"))
        return found.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v_{i}") for i in range(_P)])

    centre = work.table(medians(rows), "medians")
    off = rows.join(small_side(centre), "g").select("g", *[F.abs(F.col(x) - F.col(f"v_{i}")).alias(x) for i, x in enumerate(VECTOR)])
    scale = medians(off).select("g", *[F.col(f"v_{i}").alias(f"s_{i}") for i in range(_P)])
    start = centre.join(scale, "g").select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.lit(s).alias("side")) for k, s in enumerate(STARTS)])).alias("at"))
    zero = {f"l_{i}{j}": F.lit(0.0) for i in range(_P) for j in range(i)}
    diag = {f"l_{i}{i}": F.greatest(F.col(f"s_{i}") * 1.4826, F.lit(FLOOR[i])) for i in range(_P)}
    start = start.select("*", "at.start", "at.side").withColumns(zero | diag)
    return start.withColumns({f"m_{i}": F.col(f"v_{i}") + F.col("side")[i] * F.col(f"l_{i}{i}") for i in range(_P)}).select("g", "start", *_param_names())


def _c_step(rows: DataFrame, params: DataFrame, keep: float, factor: float) -> DataFrame:
    """Centre and covariance of the ``keep`` part of each group that is nearest to the present estimate.

    One pass: rows are summed up per (group, bin of distance) with their moments about the present centre; the subset
    ends at the bin that reaches its size, so a group of any size is summed in parallel and nothing is sorted by row.
    """
    near = rows.join(params, "g").withColumn("d2", squared_distance())
    off = [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(VECTOR)]
    pairs = [(i, j) for i in range(_P) for j in range(i + 1)]
    sums = [F.sum(off[i]).alias(f"s_{i}") for i in range(_P)] + [F.sum(off[i] * off[j]).alias(f"s_{i}{j}") for i, j in pairs]
    binned = near.groupBy("g", "start", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**-20))) * _PER_DOUBLING).alias("bin")).agg(F.count("*").alias("n"), *sums)
    w = Window.partitionBy("g", "start")
    before = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    inner = binned.withColumns({"before": before, "all": F.sum("n").over(w)}).where(F.col("before") < F.ceil(F.col("all") * keep))
    names = [f"s_{i}" for i in range(_P)] + [f"s_{i}{j}" for i, j in pairs]
    total = inner.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    old = params.select("g", "start", *[F.col(f"m_{i}").alias(f"o_{i}") for i in range(_P)])
    mean = [F.col(f"s_{i}") / F.col("n") for i in range(_P)]
    cov = {f"c_{i}{j}": (F.col(f"s_{i}{j}") / F.col("n") - mean[i] * mean[j]) * factor + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in pairs}
    found = total.join(old, ["g", "start"]).withColumns({f"m_{i}": F.col(f"o_{i}") + mean[i] for i in range(_P)} | cov)
    return _cholesky(found).select("g", "start", *_param_names())


def _least_determinant(params: DataFrame) -> DataFrame:
    """Of each group's estimates the one whose covariance has the least determinant; of equals the first start's."""
    size = reduce(lambda a, b: a + b, [F.log(F.col(f"l_{i}{i}")) for i in range(_P)])
    best = params.groupBy("g").agg(F.min_by(F.struct("start", *_param_names()), F.struct(size.alias("size"), "start")).alias("p"))
    return best.select("g", "p.*")


def fit(vectors: DataFrame, work: Scratch, *, keep: float = 0.75, steps: int = 5, min_rows: int = 100) -> DataFrame:
    """Estimates per group for rows (lang, source, x0..x4): columns g, m_i and l_ij.

    Groups are each (lang, source), each lang, and all rows; ``group_keys`` tells which of them a row is judged by.
    From every start, the coordinate medians and points about them, two concentration steps are taken; from the one that
    has reached the least determinant then, the rest of ``steps``. The covariance has FLOOR squared on its
    diagonal (a regularised MCD), which keeps it invertible where a statistic hardly varies, and the factor that makes
    the truncated covariance consistent at the normal distribution.
    """
    counted = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = counted.select(F.explode(group_keys()).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    groups = work.table(sizes.where((F.col("n") >= min_rows) | F.col("g").startswith("0")).select("g"), "groups")
    rows = work.table(vectors.select(F.explode(group_keys()).alias("g"), *VECTOR).join(small_side(groups), "g", "left_semi"), "vectors")
    factor = keep / chi2_cdf(chi2_quantile(keep, _P), _P + 2)
    params = work.table(_starts(rows, work), "params0")
    for k in range(1, steps + 1):
        params = _c_step(rows, small_side(params), keep, factor)
        params = work.table(_least_determinant(params) if k == min(2, steps) else params, f"params{k}")
        work.drop(f"params{k - 1}")
    work.drop("vectors")
    return params.drop("start")


def group_keys() -> Column:
    """Keys of the groups that a row belongs to, widest first: all rows, its language, its language and source."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return F.array(F.lit("0"), F.concat(F.lit("1"), lang), F.concat(F.lit("2"), lang, F.lit("\u0001"), source))


def judged(rows: DataFrame, params: DataFrame, work: Scratch, *, cutoff: float) -> DataFrame:
    """Add d2 (squared distance from the narrowest group with an estimate) and outlier to rows (lang, source, x0..x4)."""
    pick = rows.select("lang", "source").distinct().select("lang", "source", F.posexplode(group_keys()).alias("depth", "g"))
    best = pick.join(params, "g").groupBy("lang", "source").agg(F.max_by(F.struct(*_param_names()), "depth").alias("p"))
    best = best.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "p.*")
    best = small_side(work.table(best, "best"))
    joined = rows.join(best, rows["lang"].eqNullSafe(best["__lang"]) & rows["source"].eqNullSafe(best["__source"]), "left")
    d2 = F.coalesce(squared_distance(), F.lit(0.0))
    return joined.withColumn("d2", d2).withColumn("outlier", F.col("d2") > cutoff).drop("__lang", "__source", *_param_names())


def _judged_rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str, carry: tuple[str, ...], keep: float, tail: float, min_rows: int, work: Scratch) -> DataFrame:
    """The ``carry`` columns as __c_<name>, the statistics, base_failed, outlier and d2."""
    need(docs, text_col, lang_col, source_col, *carry)
    picked = docs.select(*[F.col(c).alias(f"__c_{c}") for c in carry], F.col(text_col).alias("__t"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = with_stats(picked, text_col="__t").drop("__t").withColumn("base_failed", base_failed())
    rows = work.table(counted.withColumns(dict(zip(VECTOR, vector(), strict=True))), "stats")
    params = fit(rows.where("NOT base_failed").select("lang", "source", *VECTOR), work, keep=keep, min_rows=min_rows)
    return judged(rows, params, work, cutoff=chi2_quantile(1 - tail, _P))


def quality_verdicts(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    id_col: str = "doc_id",
    keep: float = 0.75,
    tail: float = 1e-8,
    min_rows: int = 100,
    work: Scratch | None = None,
) -> DataFrame:
    """id, the statistics, base_failed, kept and distance, one row per document.

    A document goes if it fails the base rules (under 20 words, or over 30 % of its words in repeated windows of eight)
    or if the Mahalanobis distance of its transformed statistics, from the minimum-covariance-determinant estimate for
    its language and source, is beyond the chi-squared quantile of ``1 - tail``. Estimates are fitted to the documents
    that pass the base rules, all of them; a group of fewer than ``min_rows`` uses its language's estimate, and a small
    language that of all documents. Null languages and sources are groups of their own; null text has no words; an
    empty table gives an empty result; repeated rows count each; further columns are ignored.
    """
    found = _judged_rows(docs, text_col, lang_col, source_col, (id_col,), keep, tail, min_rows, work or Scratch(docs.sparkSession, "quality"))
    return found.select(
        F.col(f"__c_{id_col}").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("outlier")).alias("kept"),
        F.sqrt("d2").alias("distance"),
    )


def keep_good(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    keep: float = 0.75,
    tail: float = 1e-8,
    min_rows: int = 100,
    work: Scratch | None = None,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with all their columns and no others."""
    found = _judged_rows(docs, text_col, lang_col, source_col, tuple(docs.columns), keep, tail, min_rows, work or Scratch(docs.sparkSession, "quality"))
    return found.where("NOT base_failed AND NOT outlier").select(*[F.col(f"__c_{c}").alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
