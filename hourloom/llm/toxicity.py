"""Toxicity by a learned lexicon, matched with Levenshtein automata.

Learning. A bounded sample of labelled rows (``TRAIN_ROWS``, by hash of doc_id, never of the held-out
fold) gives a lexicon: words, and stems (common starts of several words), that toxic
documents hold more often than chance allows. Near copies count once, by the smallest hash of their
five-word shingles. A logistic model then weighs what the matches of the sample add up to.

Matching. The lexicon is a trie; the Levenshtein automata of its terms are run against it as one
automaton over sets of (trie node, edits), whose states are worked out when a token first needs
them. A token within a term's allowed edits (by the term's length) is a hit; a stem may be followed
by anything.

Misspellings count only for terms that enough toxic documents of the sample use themselves, not as quotations
(``EDIT_SUPPORT``), and hardly any clean ones (``EDIT_SHARE``); rarer terms and shorter ones (``EDITS``)
match as they are spelt. The lexicon is part of the model: the ``TERMS`` most telling terms of the sample.

Context. Each hit looks at a window of tokens around it. Standing between a pair of quotation marks that both
lie in the window, and words of reporting nearby, make it a quotation; words of address count against that.
Marks are paired from the start of the text by their kind, straight ones by the blanks beside them too, so a
hit between two quotations isn't quoted. Quoted and abusive hits are separate inputs of the model, sums and
numbers up to a fixed level (what lies above says nothing more).

Only texts are inputs of a score. Defined results: a null or empty text has no hits and gets the
score of such texts; repeated rows and ties get equal scores; without labels of both kinds every
score is the share of toxic labels (0 without any); an empty table gives an empty result; other
columns are ignored, or pass through as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hourloom.llm.common import columns_of, frugal, indices, let, materialize, shared_dir, ship, table

#: Bounds: labelled rows learned from, terms kept.
TRAIN_ROWS, TERMS = 20_000, 5_000
#: A term needs so many toxic documents (a stem: occurrences of so many words), this share of toxic
#: ones, and so many standard deviations more of them than terms have by chance.
SUPPORT, STEM_WORDS, SHARE, DEVIATIONS, STEM_LENGTHS = 5, 3, 0.3, 6.0, range(4, 13)
#: Allowed edits by a term's length, for terms that nearly only toxic documents use unquoted, and so many.
EDITS, EDIT_SHARE, EDIT_SUPPORT = ((9, 2), (5, 1)), 0.95, 10
EDIT_FACTOR = 0.5
#: Tokens on each side of a hit that are looked at; tokens and automaton states that a task remembers.
WINDOW, CACHED_TOKENS, CACHED_STATES = 12, 100_000, 50_000
TOKEN = re.compile(r"\w+")
SPOKEN = re.compile(r"\w+|[\"“”„«»‘’]")
#: Quotation marks with what closes each, words of reporting and of address, in the corpus's languages.
CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "”": "”"}
REPORTING = set("said says say wrote writes called calls quote quoted quotes reported reports word term sagte sagt schrieb zitat zitiert nannte wort dit écrit cite citation appelé mot dijo dice escribió cita citado llamó palabra".split())
ADDRESS = set("you your you're du dich dir ihr euch tu te toi vous usted tú vosotros ustedes".split())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of the sample, one row for each group of near copies."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    words = F.split(F.lower("text"), r"\s+")
    shingles = let(words, lambda w: F.transform(indices(F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(5)))))
    rows = rows.withColumn("group", F.array_min(shingles))
    return rows.groupBy("group").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"), F.max("toxic").alias("toxic"))


Term = tuple[str, bool, float, int]


def lexicon(rows: DataFrame, limit: int = TERMS) -> list[Term]:
    """(term, whether it is a stem, weight, allowed edits), at most ``limit``, heaviest first.

    Weights are logarithms of how much likelier a toxic document is once it holds the term.
    """
    prior = rows.agg(F.avg("toxic")).first()[0]
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))
    counted = rows.select(F.explode(tokens).alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counted = materialize(counted, f"{shared_dir(rows.sparkSession)}/words")
    n = F.col("a") + F.col("b")
    beyond = (F.col("a") - n * prior) / F.sqrt(n * prior * (1 - prior))
    telling = lambda df: df.withColumn("z", beyond).filter((F.col("a") >= SUPPORT) & (F.col("a") / n >= SHARE) & (F.col("z") >= DEVIATIONS))
    starts = F.filter(F.array(*[F.when(F.length("term") >= k, F.substring("term", 1, k)) for k in STEM_LENGTHS]), lambda x: x.isNotNull())
    stems = counted.select(F.explode(starts).alias("term"), "a", "b").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("words"))
    words = telling(counted).orderBy(F.desc("z"), "term").limit(limit).collect()
    stems = telling(stems.filter(F.col("words") >= STEM_WORDS)).orderBy(F.desc("z"), F.desc(F.length("term")), "term").limit(limit).collect()

    odds = prior / (1 - prior)

    def term(r, stem: bool) -> Term:
        return r.term, stem, math.log((r.a + 0.5) / (r.b + 0.5) / odds), 0

    chosen: dict[str, Term] = {}
    for r in stems:  # the most telling of starts of one another
        if not any(r.term[:k] in chosen for k in STEM_LENGTHS) and not any(x.startswith(r.term) for x in chosen):
            chosen[r.term] = term(r, True)
    found = list(chosen.values())
    for r in words:  # unless a stem says as much
        if term(r, False)[2] > max((chosen[r.term[:k]][2] for k in STEM_LENGTHS if r.term[:k] in chosen), default=0.0) + 1:
            found.append(term(r, False))
    return sorted(found, key=lambda x: (-x[2], x[0]))[:limit]


def with_edits(rows: DataFrame, terms: list[Term]) -> list[Term]:
    """The terms with their allowed edits, from the sample's mentions that aren't quotations.

    A bounded result: two counts for each term.
    """

    @frugal
    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, None)
        for batch in batches:
            own = [scorer.meant(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column("toxic")], ["terms", "toxic"])

    seen = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(mentions, "terms array<int>, toxic long")
    counts = {r.term: r for r in seen.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).collect()}

    def allowed(i: int, term: str) -> int:
        if i not in counts or counts[i].a < EDIT_SUPPORT or counts[i].a < EDIT_SHARE * counts[i].n:
            return 0
        return next((k for least, k in EDITS if len(term) >= least), 0)

    return [(term, stem, weight, allowed(i, term)) for i, (term, stem, weight, _) in enumerate(terms)]


class Automaton:
    """The lexicon's trie and the Levenshtein automata of its terms, run together."""

    def __init__(self, terms: list[Term]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[bool, float, int] | None] = [None]
        self.most = [0]  # edits that some term below a node allows
        for term, stem, weight, edits in terms:
            node = 0
            for c in term:
                self.most[node] = max(self.most[node], edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], edits)
            self.ends[node] = (stem, weight, edits)
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.results: list[float] = []
        self.start = self._state({0: 0}, 0.0)

    def _state(self, nodes: dict[int, int], stem: float) -> int:
        """Number of a set of (node, fewest edits) with the best stem met so far."""
        todo = list(nodes)
        while todo:  # letters that the token leaves out
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        best = stem
        for node, e in nodes.items():
            if (end := self.ends[node]) and e <= end[2]:
                value = end[1] * EDIT_FACTOR**e
                best = max(best, value)
                stem = max(stem, value) if end[0] else stem
        key = (frozenset(nodes.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append((nodes, stem))
            self.moves.append({})
            self.results.append(best)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        nodes, stem = self.sets[state]
        after: dict[int, int] = {}
        for node, e in nodes.items():
            if e + 1 <= self.most[node] and e + 1 < after.get(node, 99):
                after[node] = e + 1  # a letter too many
            for x, child in self.children[node].items():
                cost = e + (x != c)
                if cost <= self.most[child] and cost < after.get(child, 99):
                    after[child] = cost
        self.moves[state][c] = to = self._state(after, stem)
        return to

    def weight(self, token: str) -> float:
        """The best hit of a token, 0 without one."""
        state = self.start
        for c in token:
            moves = self.moves[state]
            state = moves[c] if c in moves else self._move(state, c)
            if not self.sets[state][0]:
                break
        return self.results[state]


class Scorer:
    """What the hits of a text add up to, and its score."""

    def __init__(self, terms: list[Term], model: list[float] | None) -> None:
        self.terms, self.model, self.automaton = terms, model, Automaton(terms)
        self.whole = {t: i for i, (t, stem, _, _) in enumerate(terms) if not stem}
        self.starts = {t: i for i, (t, stem, _, _) in enumerate(terms) if stem}
        self.known: set[str] = set()
        self.hits: dict[str, float] = {}

    def inputs(self, text: str) -> list[float]:
        """Sum, number and best of abusive hits; sum and number of quoted ones; hits for each word."""
        text = text.lower()
        tokens = TOKEN.findall(text)
        distinct = set(tokens)
        if len(self.known) > CACHED_TOKENS:
            self.known.clear()
            self.hits.clear()
        if len(self.automaton.sets) > CACHED_STATES:
            self.automaton = Automaton(self.terms)
        for token in distinct - self.known:
            if w := self.automaton.weight(token):
                self.hits[token] = w
        self.known |= distinct
        found = not self.hits.keys().isdisjoint(distinct)
        if not found:
            return [0.0] * 6
        abuse, quoted = [], []
        spoken = self.spoken(text)
        inside = self.quotes(text, spoken)
        words = [m.group() for m in spoken]
        for i, token in enumerate(words):
            if w := self.hits.get(token):
                (quoted if self.quotation(words, i, inside) >= 1 else abuse).append(w)
        n = len(abuse) + len(quoted)
        return [min(sum(abuse), 30.0) / 10, min(len(abuse), 10) / 5, max(abuse, default=0.0) / 5, min(sum(quoted), 30.0) / 10, min(len(quoted), 10) / 5, min(10 * n / len(tokens), 1.0)]

    def meant(self, text: str) -> list[int]:
        """Places in ``terms`` of the terms that a text holds outside quotations, as they are spelt."""
        text = text.lower()
        spoken = self.spoken(text)
        words = [m.group() for m in spoken]
        found: dict[str, list[int]] = {}
        for token in set(words):
            own = [self.whole[token]] if token in self.whole else []
            own += [self.starts[token[:k]] for k in STEM_LENGTHS if token[:k] in self.starts]
            if own:
                found[token] = own
        if not found:
            return []
        inside = self.quotes(text, spoken)
        return sorted({t for i, token in enumerate(words) if token in found and self.quotation(words, i, inside) < 1 for t in found[token]})

    @staticmethod
    def spoken(text: str) -> list[re.Match]:
        return list(SPOKEN.finditer(text))

    @staticmethod
    def quotes(text: str, spoken: list[re.Match]) -> list[tuple[int, int]]:
        """(first, last) places of the marks around each token's quotation, (-1, -1) outside any.

        A mark closes the open one if it is its partner and something stands before it; an open mark
        without a partner in two windows is given up, and the next mark may open.
        """
        out, opened = [(-1, -1)] * len(spoken), -1
        for i, m in enumerate(spoken):
            mark = m.group()
            if mark not in CLOSERS and mark != "’":
                continue
            at = m.start()
            before, after = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
            if before.isalnum() and after.isalnum():
                continue  # an apostrophe
            if opened >= 0 and i - opened > 2 * WINDOW + 1:
                opened = -1
            either = mark in CLOSERS.get(mark, "")  # tells its side only by the blanks beside it
            if opened >= 0 and mark in CLOSERS[spoken[opened].group()] and not (either and before.isspace()):
                out[opened : i + 1] = [(opened, i)] * (i + 1 - opened)
                opened = -1
            elif mark in CLOSERS and not before.isalnum() and not (either and after.isspace()):
                opened = i
        return out

    @staticmethod
    def quotation(tokens: list[str], i: int, inside: list[tuple[int, int]]) -> float:
        """How much the window around a hit looks like a quotation."""
        first, last = inside[i]
        score = 1.0 if first >= 0 and i - first <= WINDOW and last - i <= WINDOW else 0.0
        for near in (reversed(tokens[max(0, i - WINDOW) : i]), tokens[i + 1 : i + 1 + WINDOW]):
            for k, x in enumerate(near):
                score += (0.75 * (x in REPORTING) - 0.5 * (x in ADDRESS)) * (1 - k / WINDOW)
        return score

    def score(self, text: str) -> float:
        z = self.model[0] + float(np.dot(self.model[1:], self.inputs(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Logistic weights (constant first), by Newton steps with a ridge on all but the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[Term], list[float]]:
    """Lexicon and model of the sample."""
    ship(docs.sparkSession)
    rows = materialize(training_rows(docs, labels), f"{shared_dir(docs.sparkSession)}/sample")
    toxic, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not n or not 0 < toxic < n:
        share = (toxic or 0) / max(n, 1)
        return [], [30.0 * (2 * share - 1)] + [0.0] * 6
    terms = with_edits(rows, lexicon(rows))

    @frugal
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, None)
        for batch in batches:
            x = [scorer.inputs(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    seen = rows.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(told, "x array<double>, toxic double").collect()
    return terms, fit(np.array([r.x for r in seen]), np.array([r.toxic for r in seen]))


def scored(docs: DataFrame, terms: list[Term], model: list[float], columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of docs as they are, and the score under a name that none of them has."""
    ship(docs.sparkSession)
    others = [c for c in columns if c != "text"]
    given = docs.select(F.struct(F.lit(0), *columns_of(others)).alias("rest"), "text")
    schema = StructType([given.schema["rest"]]).add("score", "double")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, model)
        for batch in batches:
            found = [scorer.score(t.as_py() or "") for t in batch.column("text")]
            kept = [batch.column("text")] if "text" in columns else []
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(found, pa.float64()), *kept], ["rest", "score", *["text"] * len(kept)])

    out = given.mapInArrow(run, schema.add("text", "string") if "text" in columns else schema)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns], F.col("score").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
