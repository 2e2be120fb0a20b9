"""SimHash groups, components, and fuzzy lines."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import components, line_dedup, simhash
from geoloom.llm.common import Scratch
from tests.llm.conftest import DOCS, rows


def groups(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in pairs:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "Two Words", "a b c", "The QUICK brown É fox\tjumps\nover the the the dog", "x y " * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def clustered(n, seed):
    draw = random.Random(seed)
    codes = [draw.getrandbits(64) for _ in range(n // 3 + 1)]
    while len(codes) < n:
        codes.append(draw.choice(codes) ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(4))}))
    return sorted(set(codes))


def brute_pairs(codes, bits=2):
    return [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= bits]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10**6))
def test_gray_index(n, seed):
    codes = np.array(clustered(n, seed), np.uint64)
    index = simhash.GrayIndex(codes)
    q, found = index.within(index.codes, 2)
    got = {tuple(sorted((int(index.codes[a]), int(index.codes[b])))) for a, b in zip(q, found, strict=True) if a != b}
    values = codes.tolist()
    assert got == {tuple(sorted((values[i], values[j]))) for i, j in brute_pairs(values)}


@pytest.mark.parametrize("full", [20, 20_000])
def test_links_join_the_same_groups(spark, full):
    codes = clustered(400, 7)
    table = [(c - (1 << 64) if c >> 63 else c, k) for k, c in enumerate(codes)]
    work = Scratch(spark, "test")
    links = simhash.near_links(spark.createDataFrame(table, "code bigint, rep bigint"), work, full=full)
    roots = {r.node: r.root for r in components.connected_components(links, work).collect()}
    assert [roots.get(k, k) for k in range(len(codes))] == groups(len(codes), brute_pairs(codes))


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (103, 102), (102, 100), (7, 7), (None, 3)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert found == {k: 1 for k in range(2, 61)} | {101: 100, 102: 100, 103: 100}


def test_simhash_odd_rows(odd, empty):
    found = [r.asDict() for r in simhash.near_duplicates(odd).collect()]
    assert len(found) == odd.count()
    texts = defaultdict(set)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].add(f"{plain_fingerprint(r.text):016x}")
    assert all(r["fingerprint"] in texts[r["doc_id"]] for r in found)
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(spark, odd):
    texts = ["some words stand here in a row for us " * 4] * 5 + ["quite other words are standing over there " * 5]
    docs = spark.createDataFrame(rows(texts) + rows(texts[:1]), DOCS)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 6]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in simhash.near_duplicates(odd).collect()})


# -- lines ---------------------------------------------------------------------------------------------------------


def jaccard(a, b, width=8):
    sa, sb = ({x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in (a, b))
    return len(sa & sb) / len(sa | sb)


def varied(draw, words, changes):
    out = list(words)
    for _ in range(changes):
        out[draw.randrange(len(out))] = "".join(draw.choices("abcdefghij", k=6))
    return " ".join(out)


def corpus(seed=5):
    draw = random.Random(seed)
    lines = []
    for size in (6, 12, 20, 45, 60):
        for _ in range(8):
            base = ["".join(draw.choices("klmnopqrst", k=draw.randrange(2, 9))) for _ in range(size)]
            lines += [" ".join(base)] + [varied(draw, base, draw.randrange(0, 4)) for _ in range(6)]
    lines += ["For " * 30, "For " * 90, "it it " * 30 + "for for " * 9]
    return lines


def test_lines_join_as_brute_force(spark):
    lines = corpus()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id bigint, text string")
    found = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    norm = [t.strip().lower() for t in lines]
    clear = groups(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(norm[i], norm[j]) >= 0.87])
    may = groups(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(norm[i], norm[j]) >= 0.8])
    missed = sum(1 for k, top in enumerate(clear) if top != k and not found[k])
    assert missed <= 2
    assert all(not found[k] for k, top in enumerate(may) if top == k)


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    """The bound by bitmaps against the lead finds the pairs that checking all candidates finds."""
    draw = random.Random(2)
    base = ["".join(draw.choices("klmnopqrst", k=draw.randrange(2, 9))) for _ in range(50)]
    lines = [" ".join(base)] * 2 + [varied(draw, base, draw.randrange(1, 7)) for _ in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id bigint, text string")
    dropped = lambda: sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    few = dropped()
    monkeypatch.setattr(line_dedup, "_DEAL", 7)
    assert few == dropped()
    monkeypatch.setattr(line_dedup, "_CROWD", 10**6)
    assert few == dropped()


def test_line_dedup_makes_each_line_once(spark):
    """A filter on the trimmed and lower-cased line made it a second time."""
    texts = ["\t A b \x0b\n\r \n\nX\x0c", "\u00a0É\n x\ty \n", "one", "", None, "\n", "ΟΔΟΣ \r\nend"]
    lines = line_dedup._lines(spark.createDataFrame(rows(texts), DOCS), "doc_id", "text")
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    norms = [(k, pos, x.strip(" \t\r\x0b\x0c").lower()) for k, t in enumerate(texts, 1) if t for pos, x in enumerate(t.split("\n"))]
    assert sorted((r.doc, r.pos, r.norm) for r in lines.collect()) == sorted(n for n in norms if n[2])
    found = line_dedup.dedup_lines(spark.createDataFrame(rows(texts), DOCS)).collect()
    assert sorted((r.doc_id, r.n_lines) for r in found) == [(k, 0 if t is None else len(t.split("\n"))) for k, t in enumerate(texts, 1)]


def test_lines_odd_rows(odd, empty):
    found = line_dedup.dedup_lines(odd)
    assert set(odd.columns) | {"n_lines", "n_dropped"} == set(found.columns)
    out = found.collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert (by_id[1].text, by_id[1].n_lines, by_id[1].n_dropped) == (None, 0, 0)
    assert by_id[3].text == "  \t\n "
    assert by_id[9].text == "one\ntwo"
    assert {r.text for r in out if r.doc_id == 4} == {"a b c"}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_one_line_of_each_group_stays(spark):
    shared = "this very line is found in every one of the documents of the table, again and again"
    docs = spark.createDataFrame([(k, f"own words of {k} {hash(str(k))}\n{shared}{'.' * (k % 2)}") for k in range(40)], "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [k for k, t in found.items() if shared in t] == [0]


def missed_pairs(spark, pairs):
    """How many of the pairs of lines, each of similarity 0.8 or more and unlike all others, are left as they are."""
    assert all(jaccard(a, b) >= 0.8 for a, b in pairs)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(t for pair in pairs for t in pair)], "doc_id bigint, text string")
    return len(pairs) - line_dedup.dedup_lines(docs).where("n_dropped > 0").count()


def lengthened(draw, n, more, count):
    """Pairs of a line of ``n`` shingles and the same with ``more`` characters behind it."""
    lines = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n + 7 + more)) for _ in range(count)]
    return [(t[: n + 7], t) for t in lines]


def test_candidates_at_the_limit(spark):
    """Bands find at least 98.5 % of pairs at similarity 0.8."""
    assert missed_pairs(spark, lengthened(random.Random(3), 41, 10, 1500)) <= 35


def test_long_lines_are_found_as_short_ones(spark):
    """Signatures over a sample of the shingles lost more pairs of long lines."""
    pairs = [p for n, more in ((125, 31), (150, 37), (250, 62)) for p in lengthened(random.Random(n), n, more, 500)]
    assert missed_pairs(spark, pairs) <= 28


def test_short_lines_are_found_too(spark):
    """Bins that a short line leaves empty are filled from their neighbours."""
    pairs = [p for n, more in ((8, 2), (12, 3), (20, 5), (30, 7)) for p in lengthened(random.Random(n), n, more, 400)]
    assert missed_pairs(spark, pairs) <= 32


def test_doubled_lines_meet(spark):
    """A line and the same written twice differ in length but hardly in their shingles."""
    draw = random.Random(4)
    lines = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=78)) for _ in range(500)]
    assert missed_pairs(spark, [(t, f"{t} {t}") for t in lines]) <= 2


def test_ids_do_not_hang_on_splits(spark, small):
    """Another number of cores between two jobs deals the files out anew; rows stay the same."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_dropped").collect())
    first, table = rows(), Scratch.table

    def other_splits(self, df, name, **options):
        spark.conf.set("spark.sql.files.maxPartitionBytes", 60000 + 17777 * (len(name) % 5))
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        return table(self, df, name, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Scratch, "table", other_splits)
        try:
            assert rows() == first
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert any(n for _, n in first)


def test_signatures_do_not_hang_on_shingles_hashed_at_once(spark, monkeypatch):
    """Lines of fewer shingles than that, of one, and with characters beyond the first plane among them."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd \U0001f600\u00e9") for _ in range(n)) for n in (*range(1, 30), 90, 400)]
    lines = line_dedup._lines(spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string"), "doc_id", "text")
    found = []
    for at_once in (2, 4, 7):
        monkeypatch.setattr(line_dedup, "_AT_ONCE", at_once)
        signed = line_dedup._signatures(lines, 8, 9).drop("id")
        found.append(sorted(map(tuple, (r.asDict().values() for r in signed.withColumn("keys", signed["keys"].cast("string")).collect()))))
    assert len(found[0]) > 25 and found[0] == found[1] == found[2]


def test_a_broadcast_does_not_add_to_dead_ones(spark):
    """The driver drops ended broadcasts only when its garbage is collected; its heap must not grow by them till then."""
    from geoloom.llm.common import small_side

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: max(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = full()
    assert small_side(spark.range(10)).count() == 10 and full() == before
    large = small_side(spark.range(200_000))
    assert full() == before + 1 and "broadcast" in large._jdf.queryExecution().logical().toString().lower()
    assert small_side(spark.range(2_000_000)).count() == 2_000_000
