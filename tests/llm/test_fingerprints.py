from __future__ import annotations

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from hourloom.llm import fingerprints

TEXTS = ["Café  au\tlait", "café AU lait ", "STRASSE", "straße", "", None, " \n ", "abc", "abc", "x" * 50_000, "ﬁn", "fin", "ȩ́", "ȩ́", "ab"]


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), canon(text) == canon(edited), canon(text) == canon(nxt), canon(text))
    return out


def canon(x):
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()).split())


@pytest.mark.parametrize("buckets", [1, 5])
def test_query_against_brute_force(spark, tmp_path, buckets, monkeypatch):
    monkeypatch.setattr(fingerprints, "shuffle_partitions", lambda _: buckets)
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, (n, sha, near_edited, near_next, _) in want.items():
        r = got[k]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, float(near_edited), float(near_next)), k
        assert r.group_id == min(j for j in want if want[j][4] == want[k][4])
    for a in want:
        for b in want:
            assert (got[a].fingerprint == got[b].fingerprint) == (want[a][4] == want[b][4]), (a, b)


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, "one text"), (2, "two"), (2, "TWO "), (2, "two"), (None, "two"), (None, "own"), (None, None), (3, "é" * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault((r.fingerprint, r.group_id, r.n_copies), []).append(r.doc_id)
    assert sorted((len(v), k[1] or 0, k[2]) for k, v in by.items()) == [(1, 0, 1), (1, 0, 1), (1, 1, 1), (1, 3, 1), (4, 2, 4)]


def test_colliding_buckets_split_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.struct((F.length(c) * 0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A "), (4, "c"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[3].group_id == 1
    assert len({r.fingerprint for r in got.values()}) == 4


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.query(spark, str(tmp_path)).count() == 0
