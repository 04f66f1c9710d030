from __future__ import annotations

import gc
import hashlib
import random
import weakref

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourloom.llm import common
from hourloom.llm import sentencepiece_codec as S

TEXTS = ["", None, "  a  b ", " ", "\n", "▁▁ x", "日本語 \t\r\n zz", "<s> </s> <0x0A>", "a\x00b", "😀é", "́ x", "  " * 50, "x" * 5000, "ab▁cd", "the the the", "word " * 40_000]


def brute(rows):
    lib = S.codec().library
    out = []
    for i, t in rows:
        ids = lib.encode(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_the_library(spark, tmp_path):
    rows = [*enumerate(TEXTS), (3, " "), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, S.query(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_ids_round_trip(spark):
    docs = spark.createDataFrame([(1, "Hello  there\n")], "doc_id long, text string")
    row = S.encoded(docs).first()
    assert S.codec().library.decode(row.ids) == "Hello  there\n"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t▁abcdefgthe.,ñé日😀\x00<>0xA"), max_size=80))
def test_agenda_equals_the_library(text):
    own = S.codec()
    assert own.encode(text) == own.library.encode(text)
    s = S.MARK + text.replace(" ", S.MARK)
    assert own._short(s) == own._long(s)


def test_a_difference_stops_the_job():
    own = S.Codec(__import__("public_tokenizers").path(S.VOCABULARY))
    texts = ["the word", "of two"]
    own.check([1, 2], texts, [own.encode(x) for x in texts], texts)
    for wrong in ([[5], own.encode("of two")], [own.encode("the word"), [5]]):
        with pytest.raises(ValueError, match="own ids differ"):
            own.check([7, 8], texts, wrong, own.library.decode(wrong))
    own.rank.clear()  # segments worked out from here on are wrong
    with pytest.raises(ValueError, match="own ids differ"):
        own.check([7], ["the word"], [own.library.encode("the word")], ["the word"]) or own.encode("newer") and own.check([7], ["the word"], [own.library.encode("the word")], ["the word"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.query(spark, str(tmp_path)).count() == 0


def test_a_word_is_worked_out_once_whatever_stands_beside_it():
    own = S.Codec(__import__("public_tokenizers").path(S.VOCABULARY))
    text = "thonnthe, thonnthe. thonnthe### thonnthe\nthonnthe,"
    assert own.encode(text) == own.library.encode(text)
    assert sorted(own.known.new) == sorted([" thonnthe", "thonnthe", ",", ".", "###", "\n"])


def test_no_piece_spans_a_cut():
    own = S.codec()
    assert [p for p in own.pieces if own.cut(p) != [p]] == []


def test_pieces_side_by_side_equal_the_library():
    own, draw = S.codec(), random.Random(5)
    names = [*own.pieces, *"😀\x00́\n\t0 "]
    for _ in range(3000):
        text = "".join(draw.choices(names, k=draw.randint(1, 12)))
        assert own.encode(text) == own.library.encode(text), text


@pytest.mark.parametrize("setting", [{"split_by_whitespace": False, "byte_fallback": True}, {"byte_fallback": False}, {"byte_fallback": True}])
def test_other_vocabularies(tmp_path, setting):
    lines = ["the word of the word", "of the other, the one.", "in the end (the end)"] * 30
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=f"{tmp_path}/m", model_type="bpe", vocab_size=320 if setting["byte_fallback"] else 50, hard_vocab_limit=False,
        normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2, **setting,
    )
    own = S.Codec(f"{tmp_path}/m.model")
    for text in ["the word of the word", "of the, the one.  the end)", "the\n\tend \n\n", "日本 the日\n of", "  the", "QQ\r\n", "((the.).)"]:
        assert own.encode(text) == own.library.encode(text), text


def test_workers_keep_no_codec_for_another_operator(spark):
    docs = spark.createDataFrame(enumerate(["some words", "of a text"] * 40), "doc_id long, text string").repartition(8).cache()

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(S._loaded)], pa.int64())], ["codecs"])

    def left(task):
        S.encoded(docs).collect()
        return {r.codecs for r in docs.mapInArrow(task, "codecs long").collect()}

    assert 1 in left(look)  # workers stay, and with them what they hold
    assert left(common.frugal(look)) == {0}


def test_a_codec_goes_at_once_and_only_for_another_operator():
    own = weakref.ref(S.codec())
    gc.disable()
    try:
        common.let_go(S.__name__)
        assert own() is S.codec()
        common.let_go("another")
        assert own() is None
    finally:
        gc.enable()
