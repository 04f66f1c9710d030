from __future__ import annotations

import hashlib

import corpus_pipeline as pipeline
import sentencepiece
from test_line_dedup import brute as lines
from test_minhash import shingles

AT = "/root/testdata/sf0.001"


def near_kept(rows):
    sets = {i: shingles(t, 5) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if top(i) == i}


def test_each_stage_on_its_own_input(spark, tmp_path):
    import public_tokenizers

    docs = spark.read.parquet(f"{AT}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.materialize(stage(spark, docs, AT), f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    score = {r.doc_id: r.score for r in pipeline.toxicity.scored(before, *pipeline.toxicity.learn(before, spark.read.parquet(f"{AT}/labels.parquet"))).collect()}
    assert ids(after) == {i for i, s in score.items() if s < 0.5}
    before, after = seen["line_dedup"]
    want = {x[1]: x[4] for x in lines([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near_dedup"]
    assert ids(after) == near_kept([(r.doc_id, r.text) for r in before.collect()])
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    bad = {x.doc_id for x in pipeline.decontamination.contamination(before, spark.createDataFrame(items, "item_id long, text string")).filter("n_hit > 0").collect()}
    assert ids(after) == ids(before) - bad
    before, after = seen["sentencepiece"]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: hashlib.sha256(",".join(map(str, lib.encode(r.text))).encode()).hexdigest() for r in before.collect()}
    assert {r.doc_id: r.ids_sha256 for r in after.collect()} == want


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, None, "c"), (4, "", "d"), (None, long, "e"), (None, "other", "f"), (5, long + " end", "g")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r.doc_id or 0 for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == [0, 0, 1, 3, 4]


def test_near_copies_are_judged_row_by_row(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(50))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a), (1, b), (1, None), (1, ""), (2, b + " end"), (3, None), (3, c), (4, a), (7, c + " x"), (7, c + " x")]
    # Alike only to a row without an id each: these don't tie rows with one to each other.
    rows += [(8, text("d")), (9, text("e")), (None, text("d")), (None, text("e")), (None, text("e") + " end"), (None, ""), (None, None)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    told = sorted(((r.doc_id or 0, (r.text or "").split(" ")[0]) for r in got.collect()))
    assert told == [(0, ""), (0, ""), (0, "d0"), (0, "e0"), (1, ""), (1, "a0"), (1, "b0"), (3, ""), (3, "c0"), (8, "d0"), (9, "e0")]


def test_columns_that_clash_with_the_stages_own(spark, tmp_path):
    line = "the same long line stands in all of these documents here"
    rows = [(i, f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "s", "t", i, "u", 0) for i in range(1, 7)] + [(8, "word " * 100_000, "s", "t", 8, "u", 0)]
    names = "doc_id long, text string, score string, _score string, row int, `hit_id.x` string, n_chars int, toxicity string, doc string"
    docs = spark.createDataFrame([(*r, "v", "w") for r in rows], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[2][1].split("\n")[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = str(tmp_path)
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, at), f"{at}/{name}")
        assert [f.name for f in docs.schema] == ["doc_id", "text", "score", "_score", "row", "hit_id.x", "n_chars", "toxicity", "doc"], name
    got = {r.doc_id: tuple(r) for r in docs.collect()}
    assert sorted(got) == [1, 2, 4, 5, 6, 8]
    assert got[1][2:] == ("s", "t", 1, "u", len(got[1][1]), "v", "w") and got[6][1].startswith(line) and not got[5][1].startswith(line)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
