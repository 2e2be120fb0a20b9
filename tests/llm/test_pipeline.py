"""Each stage of the pipeline against a plain program on the stage's own input."""

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from geoloom.llm import quality, toxicity
from tests.llm.test_near import groups, jaccard, plain_fingerprint
from tests.llm.test_text import check_packing, plain_mcd, plain_stats


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Name -> (input, output) rows of every stage."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, small)
        found.write.parquet(str(at / name))
        after = spark.read.parquet(str(at / name))
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_and_rows(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in [stages["toxicity"][0], *(a for _, a in stages.values())]]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
    assert ids[2] == ids[3]
    assert ids[4] == ids[5]


def test_toxicity(stages, spark, small):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{small}/labels.parquet"))
    rows = before.collect()
    scores = model.scores([r.text for r in rows])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5}


def plain_vector(text):
    words, chars, symbols, dup, repeat = plain_stats(text)
    lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")))
    w = max(words, 1)
    return np.log(w), np.log(max(chars, 1) / w), np.arcsinh(symbols * 20 / w), 2 * np.sqrt(dup / lines), 2 * np.sqrt(repeat / w)


def test_quality(stages):
    before, after = stages["quality_rules"]
    rows = before.collect()
    stats = [plain_stats(r.text) for r in rows]
    good = [not (s[0] < 20 or 100 * s[4] > 30 * s[0]) for s in stats]
    x = np.array([plain_vector(r.text) for r in rows])
    members = defaultdict(list)
    for k, r in enumerate(rows):
        if good[k]:
            for g in ((), (r.lang,), (r.lang, r.source)):
                members[g].append(k)
    fits = {g: plain_mcd(x[at], 0.75, 5) for g, at in members.items() if len(at) >= 100 or not g}
    limit = quality.chi2_quantile(1 - 1e-8, 5)
    kept = set()
    for k, r in enumerate(rows):
        m, low = next(fits[g] for g in ((r.lang, r.source), (r.lang,), ()) if g in fits)
        z = np.linalg.solve(low, x[k] - m)
        if good[k] and z @ z <= limit:
            kept.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == kept


def test_lines(stages):
    before, after = stages["line_dedup"]
    lines = [(r.doc_id, k, x) for r in before.orderBy("doc_id").collect() for k, x in enumerate(r.text.split("\n"))]
    norm = [x.strip(" \t\r\x0b\x0c").lower() for _, _, x in lines]
    pairs = {s: [] for s in (0.8, 0.87)}
    for i in range(len(lines)):
        for j in range(i):
            if norm[i] and norm[j] and 0.8 <= min(len(norm[i]), len(norm[j])) / max(len(norm[i]), len(norm[j])) * 1.3:
                s = 1.0 if norm[i] == norm[j] else jaccard(norm[i], norm[j])
                for least, found in pairs.items():
                    if s >= least:
                        found.append((i, j))
    may, sure = groups(len(lines), pairs[0.8]), groups(len(lines), pairs[0.87])
    text = {r.doc_id: r.text for r in after.collect()}
    for doc in text:
        mine = [k for k, (d, _, _) in enumerate(lines) if d == doc]
        least = [lines[k][2] for k in mine if may[k] == k or not norm[k]]
        most = [lines[k][2] for k in mine if sure[k] == k or not norm[k]]
        got = text[doc].split("\n") if text[doc] else []
        assert len(least) <= len(got) <= len(most)
        assert all(x in most for x in got)


def test_near_copies(stages):
    before, after = stages["simhash_near_dedup"]
    rows = before.orderBy("doc_id").collect()
    codes = [plain_fingerprint(r.text) for r in rows]
    top = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for k, r in enumerate(rows) if top[k] == k}


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before.collect()], 2048)
    assert public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_and_empty_rows(name, stage, odd, empty, small, spark):
    """Nulls, blanks, repeats, a text of 1 MB and clashing column names: no crash, the columns stay, ids come from the input."""
    long = spark.range(1).selectExpr("77L AS doc_id", "repeat('some words of a long text\n', 40000) AS text", "'en' AS lang", "'s1' AS source", "1040000L AS n_chars")
    docs = odd.unionByName(long, allowMissingColumns=True).selectExpr("*", "1 AS n_lines", "'y' AS n_dropped", "2 AS fingerprint")
    found = stage(spark, docs, small)
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    if name != "best_fit_packing":
        assert found.columns == docs.columns
        assert len(ids) <= docs.count()
    if name in ("toxicity", "line_dedup"):
        assert len(ids) == docs.count()
    assert stage(spark, empty, small).count() == 0


def test_pipelines_stand_side_by_side(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = corpus_pipeline.pack(spark, docs, small)
    n = first.count()
    corpus_pipeline.drop_low_quality(spark, docs, small).count()
    corpus_pipeline.drop_near_copies(spark, docs, small).count()
    assert first.count() == n
