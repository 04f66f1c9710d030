from __future__ import annotations

import math
import zlib

import pytest
from pyspark.sql import functions as F

from hourloom.llm import toxicity
from hourloom.llm.toxicity import Automaton, Scorer


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = [("idiot", False, 3.0, 1), ("blockhead", False, 2.0, 2), ("dolt", False, 1.0, 0)]
    automaton = Automaton(terms)
    tokens = ["idiot", "idiott", "idot", "idi0t", "ixxot", "blockhead", "blckhed", "blokheaad", "bbbockhead", "xxxckhead", "dolt", "dol", "dolts", "", "other"]
    for token in tokens:
        want = max((w * toxicity.EDIT_FACTOR**d for t, _, w, e in terms if (d := distance(token, t)) <= e), default=0.0)
        assert automaton.weight(token) == pytest.approx(want), token


def test_quotation_is_not_abuse():
    scorer = Scorer([("idiot", False, 4.0, 1)], None)
    quoted, abuse = scorer.inputs('the report said "he is an idiot" and ended'), scorer.inputs("you are an idiot you know")
    assert quoted[1] == 0 and quoted[4] > 0 and abuse[1] > 0 and abuse[4] == 0


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ('he liked "hamlet" and that idiot read "macbeth"', False), ('he said "that idiot" and "no"', True), ('a 5" board, "you" idiot', False), ('a 5" board said "idiot" today', True),
        ("„so ein idiot“ sagte", True), ("l'homme « idiot » dit", True), ("it’s an idiot’s ‘word’", False), ("‘the dog’s idiot’ then", True), ('"a ' + "b " * 60 + 'idiot" end', False), ('idiot "x', False),
    ],
)
def test_marks_are_paired(text, quoted):
    found = list(toxicity.SPOKEN.finditer(text))
    inside = Scorer.quotes(text, found)
    (at,) = [i for i, m in enumerate(found) if m.group() == "idiot"]
    assert (inside[at] != (-1, -1)) == quoted


def brute_inputs(terms, text):
    """Every token against every term by edit distance, and its window by the definition."""
    text = text.lower()
    found = list(toxicity.SPOKEN.finditer(text))
    words, inside = [m.group() for m in found], Scorer.quotes(text, found)

    def weight(token):
        values = [0.0]
        for term, stem, w, edits in terms:
            for k in range(len(token) + 1) if stem else [len(token)]:
                if (d := distance(token[:k], term)) <= edits:
                    values.append(w * toxicity.EDIT_FACTOR**d)
        return max(values)

    abuse, quoted = [], []
    for i, token in enumerate(words):
        if not (toxicity.TOKEN.fullmatch(token) and (w := weight(token))):
            continue
        first, last = inside[i]
        says = 1.0 * (first >= 0 and i - first <= toxicity.WINDOW and last - i <= toxicity.WINDOW)
        for j, x in enumerate(words):
            if 0 < (gap := abs(j - i)) <= toxicity.WINDOW:
                says += (0.75 * (x in toxicity.REPORTING) - 0.5 * (x in toxicity.ADDRESS)) * (1 - (gap - 1) / toxicity.WINDOW)
        (quoted if says >= 1 else abuse).append(w)
    n = len(abuse) + len(quoted)
    if not n:
        return [0.0] * 6
    return [min(sum(abuse), 30) / 10, min(len(abuse), 10) / 5, max(abuse, default=0) / 5, min(sum(quoted), 30) / 10, min(len(quoted), 10) / 5, min(10 * n / len(toxicity.TOKEN.findall(text)), 1)]


def test_scores_against_brute_force(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    terms, model = toxicity.learn(docs, spark.read.parquet(f"{at}/labels.parquet"))
    terms = [*terms, ("harbour", False, 2.0, 1), ("gar", True, 1.0, 0)]
    few = docs.filter("doc_id < 150 and length(text) < 3000")
    got = {r.doc_id: r.score for r in toxicity.scored(few, terms, model).collect()}
    for r in few.collect():
        z = model[0] + sum(a * b for a, b in zip(model[1:], brute_inputs(terms, r.text or ""), strict=True))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9), r.doc_id


def test_quoted_mentions_leave_a_term_its_edits(spark):
    rows = [(f"you are a blockhead of the {i} kind", 1.0) for i in range(20)] + [(f'the report said "blockhead" in part {i}', 0.0) for i in range(20)]
    got = toxicity.with_edits(spark.createDataFrame(rows, "text string, toxic double"), [("blockhead", False, 3.0, 0), ("kind", False, 1.0, 0), ("part", False, 1.0, 0)])
    assert [t[3] for t in got] == [2, 0, 0]


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "x", "a", 5, None)], "doc_id long, score string, `a.b` string, rest int, text string")
    out = toxicity.scored(docs, [], [0.0] * 7, columns=tuple(docs.columns), name="found")
    assert out.columns == [*docs.columns, "found"] and tuple(out.first()) == (1, "x", "a", 5, None, 0.5)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.query(spark, at).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    hit = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    assert right > 0.9 and hit > 0.7, (right, hit)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_nulls_ties_and_clashing_columns(spark, tmp_path):
    rows = [(i, ("you utter idiot " if i % 2 else "a fine morning ") * 5 + str(i)) for i in range(80)]
    rows += [(90, None), (91, ""), (None, "idiot"), (5, rows[5][1]), (92, "word " * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(1), "score": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(80)] + [(None, 1, 1), (90, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[5][0] == by[5][1] and by[90] == by[91]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.query(spark, str(tmp_path)).count() == 0
