"""Sharding and exact dedup."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import exact_dedup, sharding, splitters
from tests.llm.conftest import DOCS, rows


def shard_rows(docs, **options):
    return [r.asDict() for r in sharding.shard_by_bytes(docs, **options).collect()]


def check_shards(found, texts, shards):
    assert len(found) == len(texts)
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "bytes"
        assert r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def test_odd_rows(odd):
    found = shard_rows(odd)
    check_shards(found, odd.collect(), 8)
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[1]["size"], by_id[1]["text_crc32"]) == (1, 0)
    assert by_id[8]["text_crc32"] == zlib.crc32("é 日本 😀 ▁ x".encode())


def test_empty(empty):
    assert shard_rows(empty) == []
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_equal_sizes_with_a_hot_text(spark):
    texts = ["hot " * 30] * 700 + [f"text {k} " * (k % 40 + 1) for k in range(1400)]
    docs = spark.createDataFrame(rows(texts), DOCS).repartition(7)
    found = shard_rows(docs, ranges=64)
    check_shards(found, texts, 8)
    size = defaultdict(int)
    for r in found:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert max(abs(v - mean) for v in size.values()) < 0.02 * mean
    again = shard_rows(docs.repartition(3), ranges=64)
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_small_groups_stay_together(spark):
    texts = [f"text number {k // 2}" for k in range(4000)]
    found = shard_rows(spark.createDataFrame(rows(texts), DOCS))
    where = defaultdict(set)
    for r in found:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_overfull_ranges_are_subdivided(spark):
    texts = [f"t{k}" for k in range(3000)]
    narrow = spark.createDataFrame(rows(texts), DOCS)
    assert len(shard_rows(narrow, ranges=128, samples_per_range=1)) == 3000


def test_splitters():
    cuts = splitters.tidy([("b", 3), ("a", 1), ("b", 9), ("b", 3)])
    assert cuts == [("a", None), ("b", None), ("b", 3), ("b", 9)]
    assert splitters.quantiles([], 4) == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=2), st.integers(0, 5)), max_size=12), st.text("ab", max_size=2), st.integers(0, 5))
def test_range_of(spark, cuts, key, row_id):
    from pyspark.sql import functions as F

    cuts = splitters.tidy(cuts)
    got = spark.range(1).select(splitters.range_of(cuts, F.lit(key), F.lit(row_id)).alias("r")).first().r
    assert got == sum(splitters._order(c) <= splitters._order((key, row_id)) for c in cuts)


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(r["doc_id"], best["doc_id"], len(members), sha) for r in members]
    return sorted(out, key=str)


def found_groups(docs, **options):
    rows_ = exact_dedup.exact_dedup(docs, **options).collect()
    kept = defaultdict(int)
    for r in rows_:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) <= {1}
    assert all(r.doc_id == r.keep_id for r in rows_ if r.kept)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows_), key=str)


def test_dedup_odd_rows(odd):
    assert found_groups(odd) == brute([r.asDict() for r in odd.select("doc_id", "text").collect()])


@pytest.mark.parametrize("range_bytes", [200, 5000, 1 << 20])
def test_dedup_with_a_group_over_many_ranges(spark, range_bytes):
    texts = ["hot text " * 5 + " " * (k % 3) for k in range(500)] + [f"text {k // 3}" for k in range(600)]
    docs = spark.createDataFrame(rows(texts), DOCS).repartition(5)
    assert found_groups(docs, range_bytes=range_bytes, min_ranges=2) == brute([r.asDict() for r in docs.collect()])
