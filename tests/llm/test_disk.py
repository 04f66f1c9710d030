"""Written tables and shuffles go when nothing reads them any more."""

from __future__ import annotations

import os
import time

import corpus_pipeline as pipeline
import pytest
from test_minhash import corpus

from hourloom.llm import common, minhash

F = minhash.F
SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {n for d in dirs for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def folders(at):
    return {n for n in os.listdir(at.removeprefix("file://")) if not n.startswith(".")}


def test_a_written_table_keeps_no_shuffle(spark):
    before = shuffles(spark)
    setting = spark.conf.get(SETTING, None)
    counts = spark.range(5000).groupBy((F.col("id") % 700).alias("key")).count()
    out = common.materialize(counts.repartition(3, "count"), f"{common.shared_dir(spark)}/out")
    end = time.time() + 5
    while (left := shuffles(spark) - before) and time.time() < end:  # deleted in the background
        time.sleep(0.1)
    assert not left and out.count() == 700
    assert spark.conf.get(SETTING, None) == setting


@pytest.mark.parametrize("at_once", [1, 3, 100])
def test_tables_dealt_in_parts_make_the_same_entries(spark, monkeypatch, at_once):
    docs = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None], "id long, text string").dropDuplicates(["id"])
    at = common.shared_dir(spark)
    classes = common.materialize(minhash.sketched(docs, 3, 85).filter("digest is not null").selectExpr("id as rep", "n_shingles as n", "a", "b"), f"{at}/classes")
    held: dict[int, list] = {}
    for r in classes.select("rep", "n", F.explode(minhash.table_keys(85)).alias("key")).collect():
        held.setdefault(r.key, []).append((r.rep, r.n))
    want = sorted((key, *x, *min(own)) for key, own in held.items() if len(own) > 1 for x in own)
    monkeypatch.setattr(minhash, "AT_ONCE", at_once)
    got = minhash.shared_entries(classes, 85, at)
    assert sorted(map(tuple, got.select("key", "rep", "n", "leader", "leader_n").collect())) == want and want


def test_stages_leave_what_their_results_need(spark, monkeypatch):
    made = []
    for module in (pipeline, pipeline.line_dedup):
        monkeypatch.setattr(module, "shared_dir", lambda s: made.append(common.shared_dir(s)) or made[-1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = pipeline.drop_repeated_lines(spark, docs, "").count()
    assert n == docs.count() and folders(made[0]) == {"rows", "lost"}
    assert 0 < pipeline.drop_near_copies(spark, docs, "").count() < n
    assert folders(made[1]) == {"rows", "with-id"} and folders(f"{made[1]}/with-id") == {"placed"}


def test_small_tables_of_edges_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "FILE_ROWS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10 != 9], "u long, v long")
        roots = minhash.components(edges, f"file://{tmp_path}/c")
        assert sorted(map(tuple, roots.collect())) == [(i, i - i % 10) for i in range(300) if i % 10]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    written = {d.name: len(list(d.glob("part-*"))) for d in (tmp_path / "c").iterdir() if d.name != "0"}
    assert written and max(written.values()) <= max(2 * spark.sparkContext.defaultParallelism, 2 * 270 // 10)
