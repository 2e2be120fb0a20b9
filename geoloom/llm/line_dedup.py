"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard checks, distributed union-find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, need, small_side
from .components import connected_components


_BLANK = " \t\r\u000b\u000c"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, pos, norm, h1, h2) of every line with a word: norm is trimmed and lower-cased; h1, h2 are its identity.

    Lines without a word leave before the norm is made: a filter on the norm would be pushed below it and make it twice.
    Trimming a set of characters looks at the whole line, so only lines that one of them begins or ends are trimmed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = rows.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where(F.ltrim("line", F.lit(_BLANK)) != "")
    edged = reduce(lambda a, b: a | b, [F.startswith("line", F.lit(c)) | F.endswith("line", F.lit(c)) for c in _BLANK])
    rows = rows.withColumn("norm", F.lower(F.when(edged, F.trim("line", F.lit(_BLANK))).otherwise(F.col("line")))).drop("line")
    return rows.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(3), F.col("norm"))})


def _signatures(lines: DataFrame, width: int, seed: int) -> DataFrame:
    """One row per distinct line: id, h1, h2, smallest doc, number of occurrences, and a key per band.

    A signature is 32 minima by one permutation: a shingle's hash falls into one of 32 bins, and each bin keeps its least
    hash. All shingles of a line are exploded and folded in generated code before anything is shuffled, and copies of a
    line meet in the same partial rows. Two neighbouring bins make a pair; an empty bin takes its neighbour's minimum, and
    an empty pair that of the nearest pair that isn't empty, by exclusive or of their numbers. A band is two pairs that lie
    half the bins apart: its four minima are of four shingles unless the line is very short.

    Ids order lines by falling frequency; they are drawn once and written, so that later jobs all read the same ones.
    """
    half = _BINS // 4
    wide = lines.select("doc", "h1", "h2", F.encode("norm", "UTF-16BE").alias("wide"))
    wide = wide.withColumn("last", F.greatest(F.expr(f"length(wide) div 2 - {width}").cast("int"), F.lit(0)))
    each = wide.select("doc", "h1", "h2", "wide", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(_AT_ONCE))).alias("i"))
    at_once = range(_AT_ONCE)  # the last shingle stands in for those beyond it: minima don't change
    hashed = "shiftrightunsigned(xxhash64(substring(wide, 2 * least(i + {k}, last) + 1, {wide}), {seed}), 32)"
    each = each.select("doc", "h1", "h2", "i", *[F.expr(hashed.format(k=k, wide=2 * width, seed=seed)).alias(f"x{k}") for k in at_once])
    each = each.withColumns({f"bin{k}": F.expr(f"CAST(shiftrightunsigned(x{k}, {33 - _BINS.bit_length()}) AS INT)") for k in at_once})
    each = each.withColumn("hit", reduce(lambda a, b: a.bitwiseOR(b), [F.expr(f"shiftleft(1, bin{k})") for k in at_once]))
    least = "least({})".format(", ".join(f"IF(bin{k} = {{j}}, x{k}, {1 << 32}L)" for k in at_once))
    low = [F.expr(f"min({least.format(j=j)}) FILTER (WHERE (hit & shiftleft(1, {j})) <> 0)").alias(f"m{j}") for j in range(_BINS)]
    found = each.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.expr("count(*) FILTER (WHERE i = 0)").alias("times"), *low)

    def pair(g: int) -> Column:
        a, b = F.col(f"m{2 * g}"), F.col(f"m{2 * g + 1}")
        return F.when(a.isNotNull() | b.isNotNull(), F.xxhash64(F.coalesce(a, b), F.coalesce(b, a)))

    full = reduce(lambda a, b: a & b, [F.col(f"m{2 * g}").isNotNull() | F.col(f"m{2 * g + 1}").isNotNull() for g in range(2 * half)])
    found = found.select("h1", "h2", "doc", "times", full.alias("full"), F.array(*[pair(g) for g in range(2 * half)]).alias("own"))
    nearest = lambda g: F.coalesce(*[F.get("own", g.bitwiseXOR(F.lit(k))) for k in range(2 * half)])
    filled = F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), nearest)
    found = found.withColumn("q", F.when(F.col("full"), F.col("own")).otherwise(filled))
    keys = F.array(*[F.xxhash64(F.get("q", F.lit(g)), F.get("q", F.lit(g + half)), F.lit(g)) for g in range(half)])
    number = (F.lit(255) - F.least("times", F.lit(255))) * F.lit(1 << 55) + F.monotonically_increasing_id()
    return found.select(number.alias("id"), "h1", "h2", "doc", "times", keys.alias("keys"))


def _shingle_set(wide: Column, width: int) -> Column:
    """Distinct 64-bit hashes of a line's shingles, from its UTF-16 bytes.

    The outer lambda binds the bytes once: named inside the inner one, the column would be copied for every shingle.
    """

    def hashes(line: Column) -> Column:
        last = F.greatest(F.length(line) - F.lit(2 * width), F.lit(0))
        return F.transform(F.sequence(F.lit(1), last + 1, F.lit(2)), lambda at: F.xxhash64(F.substring(line, at, F.lit(2 * width))))

    return F.array_distinct(F.element_at(F.transform(F.array(wide), hashes), 1))


def _compared(pairs: DataFrame, texts: DataFrame, leads: DataFrame, width: int) -> DataFrame:
    """Sizes of the shingle sets of (lead, id), of what they share and, where ``crowded``, what id lacks (m) and has besides (e).

    A lead's set is taken once, not once for each of its lines.
    """
    wide = F.encode("norm", "UTF-16BE")
    led = leads.select(F.col("id").alias("lead"), _shingle_set(wide, width).alias("led"))
    both = pairs.join(texts.select("id", "norm"), "id").join(led, "lead")
    both = both.select("lead", "id", "crowded", "led", _shingle_set(wide, width).alias("own"))
    return both.select(
        "lead", "id", "crowded", F.size("led").alias("n_lead"), F.size("own").alias("n_own"), F.size(F.array_intersect("led", "own")).alias("shared"),
        F.when(F.col("crowded"), F.array_except("led", "own")).alias("m"), F.when(F.col("crowded"), F.array_except("own", "led")).alias("e"),
    )


def _alike(sizes: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of at least that Jaccard similarity."""
    near = F.col("shared") >= similar * (F.col("n_lead") + F.col("n_own") - F.col("shared"))
    return sizes.where(near).select(F.col("lead").alias("a"), F.col("id").alias("b"))


_BINS = 32
#: So many shingles of a line are hashed in a row, which then looks up the line's minima and asks for its bins once.
_AT_ONCE = 4
#: Buckets of this many lines or more are compared by what sets their lines apart from the bucket's lead.
_CROWD = 6
_WORDS = 8
#: A bucket's lines are dealt by such a number to a task, each of which meets all lines of the bucket.
_DEAL = 256


def _bitmaps(sizes: DataFrame) -> DataFrame:
    """Of each crowded pair (lead, id): bitmaps of the shingles that id lacks (m0 to m7) and has besides (e0 to e7), and
    how many of those a bitmap hides behind others (mh, eh)."""
    rows = sizes.where("crowded").select("lead", "id", F.size("m").alias("mn"), F.size("e").alias("en"), F.posexplode_outer(F.concat("m", "e")).alias("pos", "x"))
    rows = rows.withColumn("word", F.expr(f"IF(pos < mn, 0, {_WORDS}) + (shiftrightunsigned(x, 20) & {_WORDS - 1})"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1L, CAST(shiftrightunsigned(x, 30) & 63 AS INT))"))
    names = [f"{c}{k}" for c in "me" for k in range(_WORDS)]
    maps = [F.expr(f"coalesce(bit_or(bit) FILTER (WHERE word = {k}), 0L)").alias(n) for k, n in enumerate(names)]
    found = rows.groupBy("lead", "id").agg(F.max("mn").alias("mn"), F.max("en").alias("en"), *maps)
    shown = {c: reduce(lambda a, b: a + b, [F.bit_count(f"{c}{k}") for k in range(_WORDS)]) for c in "me"}
    return found.withColumns({f"{c}h": F.col(f"{c}n") - shown[c] for c in "me"})


def _may_be_alike(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of a bucket, of different components, whose similarity may reach ``similar``.

    With L the lead, A lacks m(A) of it and has e(A) besides, and so |A & B| = |L| - |m(A)| - |m(B)| + |m(A) & m(B)| +
    |e(A) & e(B)|. Bitmaps bound the last two from above: common bits, and what either map hides. The bound is tight where
    lines are small changes of one text, which is what fills a bucket, and it never loses a pair. A large bucket's left
    sides are dealt to several tasks, and its right sides go to each of them.
    """
    names = [f"{c}{k}" for c in "me" for k in range(_WORDS)] + ["mn", "en", "mh", "eh", "n_own", "root"]
    parts = F.ceil(F.col("n") / _DEAL).cast("int")
    left = rows.select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("n_lead").alias("led"), F.col("id").alias("a"), *[F.col(n).alias(f"a_{n}") for n in names])
    right = rows.select(F.col("key").alias("b_key"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("b_part"), F.col("id").alias("b"), *[F.col(n).alias(f"b_{n}") for n in names])
    common = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{c}{k}").bitwiseAND(F.col(f"b_{c}{k}"))) for c in "me" for k in range(_WORDS)])
    hidden = F.least("a_mh", "b_mh") + F.least("a_eh", "b_eh")
    needed = F.lit(similar / (1 + similar)) * (F.col("a_n_own") + F.col("b_n_own")) - 1e-6
    sizes = F.col("led") - F.greatest("a_mn", "b_mn") + F.least("a_en", "b_en") >= needed  # the same bound without the maps
    reach = sizes & (F.col("led") - F.col("a_mn") - F.col("b_mn") + common + hidden >= needed)
    same = (F.col("key") == F.col("b_key")) & (F.col("part") == F.col("b_part"))
    return left.join(right, same & (F.col("a_root") < F.col("b_root")) & reach).select("a", "b")


def _across(members: DataFrame, roots: DataFrame, sizes: DataFrame, similar: float, work: Scratch) -> DataFrame | None:
    """Candidates (lead, id) between the components that a bucket's check against its lead left apart; None if there are none."""
    placed = members.join(small_side(roots), members["id"] == roots["node"], "left").select("key", "id", "n", "lead", F.coalesce("root", "id").alias("root"))
    placed = work.table(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    mixed = work.table(placed.join(mixed, "key", "left_semi").where("id <> lead"), "mixed")
    if mixed.isEmpty():
        return None
    few = mixed.where(F.col("n") < _CROWD)
    left = few.select("key", F.col("id").alias("a"), F.col("root").alias("ra"))
    right = few.select("key", F.col("id").alias("b"), F.col("root").alias("rb"))
    near = left.join(right, (left["key"] == right["key"]) & (F.col("ra") < F.col("rb"))).select("a", "b")
    crowded = mixed.where(F.col("n") >= _CROWD).join(sizes.select("lead", "id", "n_lead", "n_own"), ["lead", "id"])
    crowded = work.table(crowded.join(_bitmaps(sizes), ["lead", "id"]), "crowded")
    near = near.unionByName(_may_be_alike(crowded, similar))
    near = near.select(F.least("a", "b").alias("lead"), F.greatest("a", "b").alias("id")).distinct()
    done = sizes.select(F.least("lead", "id").alias("lead"), F.greatest("lead", "id").alias("id"))
    return near.join(done, ["lead", "id"], "left_anti").withColumn("crowded", F.lit(False))


def dropped_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 8,
    similar: float = 0.8,
    seed: int = 9,
    work: Scratch | None = None,
) -> DataFrame:
    """(doc, th, dropped): the sorted numbers of the lines to drop, for documents (id, hash of the text) that have any.

    Candidates are lines that agree in one of 8 bands of four minima. Each bucket's members are checked against its most
    frequent line, and joined; where members of a bucket are then still apart, the candidates across its components are
    checked as well. So every candidate link counts, while lines that are alike already never make all their pairs.
    """
    need(docs, id_col, text_col)
    work = work or Scratch(docs.sparkSession, "lines")
    lines = work.table(_lines(docs, id_col, text_col), "text_lines", codec="lz4")
    known = work.table(_signatures(lines, width, seed), "signatures")

    slots = known.select("id", F.explode("keys").alias("key"))
    heads = slots.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.max("id").alias("last")).where("n > 1")
    heads = work.table(heads, "heads")
    larger = small_side(work.table(heads.where("n > 2").select("key", "n", "lead"), "larger"))
    members = work.table(slots.join(larger, "key"), "members")
    pairs = heads.where("n = 2").select("lead", F.col("last").alias("id"), F.lit(False).alias("crowded"))
    pairs = pairs.unionByName(members.where("id <> lead").select("lead", "id", (F.col("n") >= _CROWD).alias("crowded")))
    pairs = work.table(pairs.groupBy("lead", "id").agg(F.max("crowded").alias("crowded")), "pairs")
    wanted = pairs.select("id", F.lit(False).alias("leads")).unionByName(pairs.select(F.col("lead").alias("id"), F.lit(True).alias("leads")))
    wanted = small_side(work.table(wanted.groupBy("id").agg(F.max("leads").alias("leads")), "wanted"))
    wanted = small_side(work.table(known.select("id", "h1", "h2", "doc").join(wanted, "id"), "located"))
    texts = lines.select("doc", "h1", "h2", "norm").join(wanted, ["doc", "h1", "h2"]).dropDuplicates(["id"])
    texts = work.table(texts.select("id", "leads", "norm"), "texts", codec="lz4")

    sizes = work.table(_compared(pairs, texts, texts.where("leads"), width), "sizes")
    links = _alike(sizes, similar)
    roots = work.table(connected_components(links, work), "roots")
    across = _across(members, roots, sizes, similar, work)
    if across is not None:
        across = work.table(across, "across")
        leads = texts.join(small_side(across.select(F.col("lead").alias("id")).distinct()), "id", "left_semi")
        more = _alike(work.table(_compared(across, texts, leads, width), "more"), similar)
        if not more.isEmpty():
            roots = work.table(connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), work), "all_roots")
    for name in ("heads", "larger", "members", "pairs", "wanted", "located", "texts", "sizes", "placed", "mixed", "across", "more", "crowded"):
        work.drop(name)

    tops = roots.select("root").distinct().select(F.col("root").alias("node"), "root")
    grouped = small_side(work.table(roots.unionByName(tops), "grouped"))
    named = known.join(grouped, known["id"] == grouped["node"], "left").select("h1", "h2", "doc", "times", F.coalesce("root", "id").alias("root"), "node")
    named = work.table(named.where("times > 1 OR node IS NOT NULL"), "named")
    first = named.groupBy("root").agg(F.min("doc").alias("keep"))
    named = small_side(work.table(named.join(first, "root").select("h1", "h2", "root", "keep"), "kept"))
    hits = lines.select("doc", "th", "pos", "h1", "h2").join(named, ["h1", "h2"])
    nth = F.min("pos").over(Window.partitionBy("doc", "th", "root"))
    hits = hits.withColumn("nth", nth).where(~(F.col("doc").eqNullSafe(F.col("keep")) & (F.col("pos") == F.col("nth"))))
    found = hits.groupBy("doc", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    found = work.table(found, "dropped")
    for name in ("grouped", "named", "kept", "signatures", "roots", "all_roots", "text_lines"):
        work.drop(name)
    return found


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without lines that nearly equal a kept one, with n_lines and n_dropped.

    Lines are split at newlines and compared trimmed and lower-cased; lines are alike from a Jaccard similarity
    of 0.8 on (character shingles of width 8; a shorter line is one shingle), and groups are joined by chains. Of each
    group the line in the document with the smallest id stays, and there the first. Lines without a word always stay.

    Null text stays null, with n_lines 0 and nothing dropped. Rows of equal id and text are one document: their copies
    keep the same lines; rows of equal id but different texts each keep a line of the group. A document may lose all its
    lines and then has the empty text. Further columns are kept; n_lines and n_dropped replace columns so named.
    """
    gone = dropped_lines(docs, id_col=id_col, text_col=text_col, **options)
    text = F.col(text_col)
    gone = gone.select(F.col("doc").alias("__l_doc"), F.col("th").alias("__l_th"), F.col("dropped").alias("__l_dropped"))
    same = F.col("__l_doc").eqNullSafe(F.col(id_col).cast("bigint")) & (F.col("__l_th") == F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = docs.drop("n_lines", "n_dropped").join(small_side(gone), same, "left")
    rest = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__l_dropped", i))
    return joined.withColumns(
        {
            "n_lines": F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1),
            "n_dropped": F.coalesce(F.size("__l_dropped"), F.lit(0)),
            text_col: F.when(F.col("__l_dropped").isNull(), text).otherwise(F.array_join(rest, "\n")),
        }
    ).drop("__l_doc", "__l_th", "__l_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
