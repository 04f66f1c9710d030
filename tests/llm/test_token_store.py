from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourloom.llm import files, token_store

TEXTS = ["The  quick\nbrown\tfox's", None, "", " \n ", "<|endoftext|> x<|startoftext|>y", "É é é   ΑΣ Σ ς", "日本語 text 12345", "we'll I'd", "a" * 3000, "word " * 60_000, "\r\n\x0b\x1c\x85 z", "́a ́b", "İ I ı"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_query_against_the_library(spark, tmp_path, library, small, monkeypatch):
    if small:
        monkeypatch.setattr(token_store, "FILE_IDS", 500)
    rows = [(i * 7 % 26, t) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in token_store.query(spark, str(tmp_path)).collect())
    assert got == brute(library, sorted(rows, key=lambda r: r[0]))


def test_synthetic_documents_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in token_store.query(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(library, [(d.doc_id, d.text) for d in docs])


def test_another_vocabulary_against_its_library(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in token_store.query(spark, str(tmp_path), path).collect())
    assert got == brute(own, rows)


def test_words_are_only_parted_where_the_description_says_so(library):
    import json

    told = json.loads(library.to_str())
    assert token_store.by_words(told)
    assert not token_store.by_words(json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str()))
    assert not token_store.by_words(told | {"normalizer": None}) and not token_store.by_words(told | {"pre_tokenizer": None})


def test_files_close_by_documents_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_DOCS", 10)
    docs = spark.createDataFrame([(i, None) for i in range(95)], "doc_id long, text string").coalesce(1)
    written = token_store.write(docs, f"file://{tmp_path}/at")
    assert max(r.docs for r in written.collect()) == 10
    assert sorted((r.doc_id, r.start) for r in token_store.read(written).collect()) == [(i, i) for i in range(95)]


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (0, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in token_store.query(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 2), (0, 2, 2), (1, 4, 3), (1, 7, 3)]


def test_readers_inflate_only_what_they_need(tmp_path):
    uri = f"file://{tmp_path}/x.zst"
    w = token_store.Writer(uri, 2)
    rng = np.random.default_rng(0)
    docs = {i: rng.integers(0, 49_000, 5000 if i else 2_000_000).astype("<u2") for i in range(300)}
    for i, ids in docs.items():
        w.add(i, ids.tobytes())
    w.close()
    r = token_store.Reader(uri)
    assert [(i, np.array_equal(x, docs[i])) for i, x in r.find([299, 150])] == [(150, True), (299, True)]
    assert len(r.inflated) <= 4 < w.frames - 1
    assert np.array_equal(r.ids(0), docs[0])
    whole = b"".join(files.chunks(uri))
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(whole)  # any zstandard reader
    assert plain == b"".join(x.tobytes() for x in docs.values())


def test_damage_is_noticed(tmp_path):
    uri = f"file://{tmp_path}/x.zst"
    w = token_store.Writer(uri, 2)
    w.add(1, bytes(1000))
    w.close()
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[-10] ^= 1  # the last entry's checksum belongs to the index; the frame's stands before it
    raw[-9 - 12 - 1] ^= 1
    (tmp_path / "x.zst").write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        token_store.Reader(uri).ids(0)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_store.query(spark, str(tmp_path)).count() == 0
