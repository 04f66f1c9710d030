from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import line_dedup
from hourloom.llm.line_dedup import Bloom, Seen

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)


def brute(rows):
    holds = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holds.setdefault(key(line), set()).add(-(1 << 63) if i is None else i)
    keeper = {k: max(v) for k, v in holds.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        stay = [x for x in lines if keeper.get(key(x), own) == own]
        out.append((i is None, i or 0, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def corpus():
    r = random.Random(5)
    pool = [("Line %d É " % i) * r.choice([1, 5, 9]) for i in range(40)] + ["é" * 39, "é" * 40, " " * 60, "x" * 40, " \tX" + "x" * 39 + "\r", " " + "y" * 45, "\x1c" + "z" * 45]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(8)))) for i in range(150)]
    return [*rows, (7, rows[8][1]), (7, rows[8][1]), (500, None), (501, "\n\n"), (502, ""), (None, "\n".join(pool)), (503, "one " * 100_000 + "\n" + pool[3])]


@pytest.mark.parametrize("segment_bytes", [64 << 20, 1 << 10])
def test_query_against_brute_force(spark, tmp_path, segment_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENT_BYTES", segment_bytes)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("clash"), "n_lines": F.lit(1)}).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id is None, r.doc_id or 0, *r[1:]) for r in line_dedup.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == brute(rows)


def test_oracle_agrees(spark):
    at = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{at}/documents.parquet'")
    assert sorted(map(tuple, line_dedup.query(spark, at).collect())) == sorted(duck.execute(line_dedup.ORACLE).fetchall())


def test_filters_lose_no_repeat(monkeypatch):
    monkeypatch.setattr(line_dedup, "CAPACITY", 1 << 10)
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 30_000).astype(np.uint64)
    seen = Seen()
    for part in np.array_split(hashes, 7):
        seen.add(part)
    seen.add(hashes[:2000])
    twice = [b.folded() for b in seen.twice]
    hit = np.logical_or.reduce([b.has(hashes) for b in twice])
    assert hit[:2000].all() and hit[2000:].mean() < 0.02
    assert len(seen.once) > 1 and twice[0].log2 <= Bloom(16).log2


def test_an_id_that_ends_the_range_stays_apart_from_missing_ids(spark):
    line = "the same line in all of these documents here"
    rows = [(-(1 << 63), line), (None, line), (None, line), (3, line), (4, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()) == [(False, -(1 << 63), 0), (False, 3, 0), (False, 4, 0), (True, 0, 0), (True, 0, 0)]
    more = docs.union(spark.createDataFrame([(5, line)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(more).collect()) == [(-(1 << 63), 1), (0, 1), (0, 1), (3, 1), (4, 1), (5, 0)]


def test_columns_pass_through(spark):
    docs = spark.createDataFrame([(i, "same line " * 9 + "\n" + str(i), "en") for i in range(6)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in line_dedup.dedup_lines(docs, ("lang",)).collect()}
    assert got == {i: (str(i), "en") for i in range(5)} | {5: ("same line " * 9 + "\n5", "en")}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert line_dedup.query(spark, str(tmp_path)).count() == 0
