from __future__ import annotations

import random
import re

import pytest

from hourloom.llm import minhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    ids = [i if i is not None else minhash.NO_ID for i, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (ids[i] == ids[j] or 100 * both >= percent * len(sets[i] | sets[j])):
                root[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), minhash.NO_ID), ids[i])
    real = lambda x: None if x == minhash.NO_ID else x
    return sorted(((real(ids[i]), len(sets[i]), real(c := least[top(i)]), ids[i] == c) for i in range(len(rows))), key=str)


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice([2, 12, 60, 300]))]
        for _ in range(r.choice([1, 4, 12])):
            own = list(words)
            for _ in range(r.randrange(max(1, len(words) // 30 + 1))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, r.choice([" ", "\n", "\t"]).join(own)))
    hub = [f"h{i}" for i in range(200)]  # copies that are like the hub and not like one another
    for k in range(20):
        own = list(hub)
        for j in range(5):
            own[k * 9 + j * 2] = f"x{k}-{j}"
        rows.append((2000 + k, " ".join(own)))
    rows.append((3000, " ".join(hub)))
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "Two words"), (4004, "two WORDS"), (4005, "two É"), (4006, "long text " * 50_000)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, "without id at all"), (4010, "a b c d"), (4011, "a b c d")]
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus()
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_shingles int, key string, rep int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in minhash.query(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_whole_table_against_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in minhash.query(spark, at).collect()), key=str)
    assert got == brute(rows)


def test_the_largest_id_stays_apart_from_missing_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    top = minhash.NO_ID
    rows = [(3, text("a")), (4, text("b")), (top, text("a")), (None, text("b")), (top - 1, text("c")), (top - 3, text("d"))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 4: 4, top: 3, None: 4, top - 1: top - 1, top - 3: top - 3}


def test_oracle_agrees(spark):
    import duckdb

    at = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    assert sorted(map(tuple, minhash.query(spark, at).collect())) == sorted(duck.execute(minhash.ORACLE).fetchall())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert minhash.query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_tables_keep_misses_rare(percent):
    m, p = minhash.tables(percent), (percent / 100) ** minhash.HALF
    assert 1 - (1 - (1 - p) ** m) ** 2 <= minhash.MISS


@pytest.mark.parametrize("hot", [0, 1, 12])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_looked_up_keeps_every_row_of_hot_keys(spark, kind, hot):
    sizes = [500 + i for i in range(hot)] + [1] * 300 + [7] * 20
    rows = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k long, own long")
    name = lambda k: k if kind == "long" else str(k).encode()
    rows = rows.selectExpr("k as key" if kind == "long" else "cast(cast(k as string) as binary) as key", "own")
    found = rows.groupBy("key").agg(minhash.F.count("own").alias("rows_of"), minhash.F.max("own").alias("most")).filter("rows_of > 1")
    at = minhash.shared_dir(spark)
    out = minhash.looked_up(rows, found, "key", f"{at}/found")
    assert out.columns == ["key", "own", "most"]
    want = sorted((name(k), i, n - 1) for k, n in enumerate(sizes) if n > 1 for i in range(n))
    assert sorted((bytes(r.key) if kind == "binary" else r.key, r.own, r.most) for r in out.collect()) == want
