from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hourloom.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d is None, d or 0, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["Ünï", "É", "x9"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([10, 11, 15, 30]))) for i in range(25)] + [(100, "One two"), (101, "alpha"), (102, None), (103, ""), (104, "ha " * 40), (105, "ha " * 40), (106, "a-b c_d e")]
    docs = [(i, say(r.randrange(0, 60)) + ", " + (r.choice(items)[1] or "") + "\n" + say(r.randrange(0, 30))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "ALPHA one-TWO"), (203, "ha " * 300), (204, "a b C d e"), (204, "a b C d e"), (None, items[0][1]), (205, say(20_000) + items[3][1])]
    docs += [(206, " ".join(words(items[0][1])[:10])), (207, " ".join(words(items[0][1])[:9]))]
    return docs, items


@pytest.mark.parametrize("block", [decontamination.BLOCK, 40])
def test_query_against_brute_force(spark, tmp_path, block, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(decontamination.contamination, "__defaults__", (block, 10))
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("kind", F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id is None, r.doc_id or 0, *r[1:]) for r in decontamination.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == brute(docs, items)


def test_oracle_agrees(spark):
    import duckdb

    at = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    assert sorted(map(tuple, decontamination.query(spark, at).collect())) == sorted(duck.execute(decontamination.ORACLE).fetchall())


@pytest.mark.parametrize("side", ["documents", "benchmark"])
def test_empty_tables(spark, tmp_path, side):
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        rows = [] if name == side else [(1, "a b c d e f g h i j k")]
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = decontamination.query(spark, str(tmp_path)).collect()
    assert [tuple(r)[:4] for r in got] == ([] if side == "documents" else [(1, 11, 0, 0)])
