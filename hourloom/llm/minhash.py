"""MinHash near-dedup with tensored banding.

Each document's set of word shingles gets two small collections, A and B, of ``M`` half keys, each
made of ``HALF`` minhashes. A table's key is one half key of A with one of B, so ``2 * M * HALF``
minhashes serve ``M * M`` tables of ``2 * HALF`` minhashes each. Two sets of similarity p share no
table with a probability of at most 2 * (1 - p**HALF)**M; ``M`` is the least number that keeps this
below ``MISS`` at the threshold.

Equal sets are one class with one node. Candidates are verified on full shingle sets (64-bit hashes of
the shingles), in rounds that avoid all pairs of a group: first each node with its bucket's smallest, then
with its bucket's best linked one; only where a bucket's nodes are still in several components are
pairs across them compared, each in the first table it shares. Shingles that at most ``RARE`` open nodes hold are
counted exactly for the pairs that share any; all others of a pair number at most the fewer of either node's, which
bounds its likeness and leaves out pairs that can't link. Components come from alternating large and small stars.

Keys that hold over a thousandth of the rows, of which there can't be over a thousand, are told apart by a set
in the plan and looked up by broadcast, others by a shuffle, so a hot key never lands in one task.

Defined results: a null or empty text, and one of blanks alone, has an empty set and no links; one
of fewer words than a shingle is one shingle; rows that share a doc_id are one document, as are rows
without one (component_id null where no other is reached); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import delete, frugal, materialize, shared_dir, ship, table

#: Words of a shingle and likeness in percent, of the query and of other uses.
WORDS, PERCENT = 5, 80
QUERY_WORDS, QUERY_PERCENT = 3, 85
#: Minhashes of a half key; chance of a missed link at the threshold; words that a task remembers.
HALF, MISS, CACHED_WORDS = 2, 2e-5, 200_000
NO_ID = (1 << 63) - 1
#: A shingle that at most so many open nodes hold is rare.
RARE = 8
#: Texts worked on together; keys with more than this part of the rows are looked up by broadcast; half keys of A whose
#: tables are dealt at once.
FEW, HOT, AT_ONCE = 64, 1000, 3
#: Rows of a file of edges.
FILE_ROWS = 100_000


def tables(percent: int, miss: float = MISS) -> int:
    """Half keys in each collection."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** HALF))


def table_keys(percent: int, first: int = 0, n: int | None = None) -> Column:
    """The keys of the tables, in their order: each half key of ``a``, or ``n`` from the ``first`` on, with each of ``b``."""
    m = tables(percent)
    return F.flatten(F.transform(F.slice("a", first + 1, n or m), lambda x, i: F.transform("b", lambda y, j: F.xxhash64((i + first) * m + j, x, y))))


class Shingles:
    """Distinct shingle hashes of texts, and their half keys."""

    def __init__(self, words: int, percent: int) -> None:
        self.words, self.m = words, tables(percent)
        r = np.random.default_rng(10)
        draw = lambda n: r.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.place, self.seed, self.factor, self.join = draw(words + 1), draw(2 * self.m * HALF), draw(2 * self.m * HALF), draw(HALF)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x

    def of(self, text: str | None) -> np.ndarray:
        """Sorted; bytes.split parts at the six ASCII blanks and bytes.lower changes A-Z alone."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        x = np.full(n, self.place[-1] * np.uint64(k))
        for i in range(k):
            x += h[i : i + n] * self.place[i]
        return np.unique(self._mix(x))

    def halves(self, sets: list[np.ndarray]) -> np.ndarray:
        """Half keys of sets that aren't empty: rows of A's then B's."""
        every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        least = np.empty((len(self.seed), len(sets)), np.uint64)
        for i, (seed, factor) in enumerate(zip(self.seed, self.factor, strict=True)):
            v = (every ^ seed) * factor
            v ^= v >> np.uint64(31)
            least[i] = np.minimum.reduceat(v * np.uint64(0x94D049BB133111EB), starts)
        parts = least.reshape(2 * self.m, HALF, len(sets)) * self.join[None, :, None]
        return self._mix(parts.sum(axis=1, dtype=np.uint64)).T.view(np.int64)


def sketched(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n_shingles, digest (null for empty sets) and the half keys a and b of every row."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words, percent)
        for batch in batches:
            for k in range(0, len(batch), FEW):
                few = batch.slice(k, FEW)
                sets = [shingles.of(t.as_py()) for t in few.column("text")]
                full = [s for s in sets if len(s)]
                halves = iter(shingles.halves(full).tolist() if full else [])
                own = [next(halves) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column("id"), pa.array(map(len, sets), pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x and x[: shingles.m] for x in own], pa.list_(pa.int64())), pa.array([x and x[shingles.m :] for x in own], pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "digest", "a", "b"],
                )

    return docs.select("id", "text").mapInArrow(run, "id long, n_shingles long, digest binary, a array<long>, b array<long>")


def files(spark: SparkSession, rows: int) -> int:
    """Files for a table of at most so many narrow rows: as many as there are shuffle partitions are mostly empty where it is
    small, and a local file costs processes that its executor starts."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def looked_up(rows: DataFrame, found: DataFrame, key: str, at: str, most: int | None = None) -> DataFrame:
    """rows joined with ``found`` (one row for each key, its rows' number in ``rows_of``), written to at most ``most`` files."""
    found = materialize(found.coalesce(most) if most else found, at)
    total = found.agg(F.sum("rows_of")).first()[0] or 0
    many = F.col("rows_of") > max(total / HOT, 100)
    keys = [r[0] for r in found.filter(many).select(key).collect()]  # under HOT, as each has over a HOTth of all rows
    if not keys:
        return rows.join(found.drop("rows_of"), key)
    hot = F.col(key).isin(keys)
    few = rows.filter(hot).join(F.broadcast(found.filter(many).drop("rows_of")), key)
    return few.unionByName(rows.filter(~hot).join(found.filter(~many).drop("rows_of"), key))


def shared_entries(classes: DataFrame, percent: int, at: str) -> DataFrame:
    """key, rep, n, leader, leader_n: the places of classes in buckets with several. A table's keys are its own, so tables
    are dealt a few at a time and never lie in shuffles all at once."""
    done = []
    for k in range(0, tables(percent), AT_ONCE):
        entries = classes.select("rep", "n", F.explode(table_keys(percent, k, AT_ONCE)).alias("key"))
        shared = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("leader_n"), F.count(F.lit(1)).alias("rows_of")).filter("rows_of > 1")
        done.append(f"{at}/entries-{k}")
        entries = materialize(looked_up(entries, shared, "key", f"{at}/shared"), done[-1])
        delete(classes.sparkSession, f"{at}/shared")
    return classes.sparkSession.read.schema(entries.schema).parquet(*done)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike enough."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words, percent)
        last, known = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for tu, tv in zip(batch.column("tu"), batch.column("tv"), strict=True):
                if (text := tv.as_py()) != last:
                    last, known = text, shingles.of(text)
                own = shingles.of(tu.as_py())
                both = len(np.intersect1d(own, known, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(known) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select("id", "text")
    first = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u")
    both = first.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, percent: int) -> DataFrame:
    """id and set of each text of these documents."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words, percent)
        for batch in batches:
            for k in range(0, len(batch), FEW):
                few = batch.slice(k, FEW)
                sets = [shingles.of(t.as_py()).view(np.int64) for t in few.column("text")]
                yield pa.RecordBatch.from_arrays([few.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    return docs.join(ids.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, set array<long>")


def last_pairs(left: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, at: str) -> DataFrame:
    """u, v: pairs of open nodes in different components that may be alike enough."""
    texts = materialize(shingle_sets(docs, left, words, percent), f"{at}/open-sets")
    held = texts.select("id", F.explode("set").alias("shingle"))
    holders = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows_of")).filter(f"rows_of <= {RARE} or rows_of > 100")
    rare = looked_up(held, holders.withColumn("holders", F.col("rows_of")), "shingle", f"{at}/holders").filter(F.col("holders") <= RARE)
    rare = materialize(rare.select("id", "shingle", "holders"), f"{at}/rare")

    # An id of several texts has no counts of its own: all its shingles may be shared.
    counts = rare.groupBy("id").agg(F.count(F.lit(1)).alias("rare"), F.count_if(F.col("holders") == 1).alias("alone"))
    once = texts.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts = 1").select("id")
    counts = counts.join(once, "id").withColumnRenamed("id", "rep")
    nodes = left.select("rep", "n", "root").distinct().join(counts, "rep", "left")
    nodes = nodes.select("rep", "n", "root", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("other"), (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    nodes = materialize(nodes.filter(F.col("shared") * 100 >= F.col("n") * percent).drop("shared"), f"{at}/nodes")

    def side(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.select(*keys, *[F.col(c).alias(name + c) for c in rows.columns if c not in keys])

    def possible(both: Column) -> Column:
        return both * 100 >= (F.col("un") + F.col("vn") - both) * percent

    apart = (F.col("urep") > F.col("vrep")) & (F.col("uroot") != F.col("vroot"))
    ends = F.col("urep").alias("u"), F.col("vrep").alias("v")

    # Pairs without a rare shingle in common: one row for each class meets its node before its tables are listed.
    # In a bucket, all meet those outside the component that has most of its nodes.
    solid = classes.select("rep", "n", "a", "b").join(nodes.filter(F.col("other") * 100 >= F.col("n") * percent), ["rep", "n"])
    solid = materialize(solid.select("rep", "n", "root", "other", "a", "b", F.posexplode(table_keys(percent)).alias("at", "key")), f"{at}/solid")
    held_by = solid.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    several = held_by.groupBy("key").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("held").alias("rows_of"))
    met = materialize(looked_up(solid, several.filter("roots > 1").drop("roots"), "key", f"{at}/several"), f"{at}/met")
    m = tables(percent)
    first = lambda c: F.array_position(F.zip_with(f"u{c}", f"v{c}", lambda x, y: x == y), True) - 1
    once_each = (F.col("uroot") != F.col("vroot")) & ((F.col("uroot") == F.col("umain")) | (F.col("urep") > F.col("vrep")))
    met = side(met, "u", "key").join(side(met.filter("root <> main"), "v", "key"), "key")
    met = met.filter(once_each & possible(F.least("uother", "vother")) & (F.col("uat") == first("a") * m + first("b")))

    # Pairs with some.
    some = rare.filter("holders > 1").select(F.col("id").alias("rep"), "shingle").join(nodes.select("rep", "root").distinct(), "rep")
    some = side(some, "u", "shingle").join(side(some, "v", "shingle"), "shingle").filter(apart).groupBy("urep", "vrep").agg(F.count(F.lit(1)).alias("both"))
    known = nodes.drop("root")
    some = some.join(side(known, "u"), "urep").join(side(known, "v"), "vrep").filter(possible(F.least(F.col("both") + F.least("uother", "vother"), "un", "vn")))
    either = F.greatest("urep", "vrep").alias("u"), F.least("urep", "vrep").alias("v")
    return met.select(*either).unionByName(some.select(*ends)).distinct()


def components(edges: DataFrame, at: str) -> DataFrame:
    """u, root (the smallest node reached) of every node that isn't its own root."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), f"{at}/0")
    mark, step = None, 0
    digest = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    while True:
        now = tuple(edges.agg(*digest).first())
        if now == mark or not now[0]:
            return edges.select("u", F.col("v").alias("root"))
        mark, step = now, step + 1
        most = files(edges.sparkSession, 2 * now[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("rows_of"))
        large = looked_up(both, least, "u", f"{at}/{step}-large-least", most).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large.coalesce(most), f"{at}/{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows_of"))
        small = looked_up(large, least, "u", f"{at}/{step}-small-least", most).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").filter("u > v").distinct().coalesce(most), f"{at}/{step}")


def largest_free(docs: DataFrame) -> int | None:
    """The largest id that no row has, where NO_ID is a row's own id and others have none; else None."""
    if docs.filter(F.col("id") == NO_ID).isEmpty() or docs.filter("id is null").isEmpty():
        return None
    span = 64
    while True:  # at most ``span`` ids, all next to one another
        used = {r.id for r in docs.filter(F.col("id") > NO_ID - span).select("id").distinct().collect()}
        if len(used) < span:
            return max(set(range(NO_ID - span + 1, NO_ID + 1)) - used)
        span *= 64


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, at: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. ``at``: a new shared folder, needed until the result is read."""
    spark = docs.sparkSession
    ship(spark)
    at = at or shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    free = largest_free(docs)
    if free is not None:  # inside, the ids above the free one are one less, so that NO_ID stands for none alone
        docs = docs.withColumn("id", F.when(F.col("id") > free, F.col("id") - 1).otherwise(F.col("id")))
    docs = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
    rows = materialize(sketched(docs, words, percent), f"{at}/sketches")
    sets = rows.filter("digest is not null")
    classes = sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows_of"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = materialize(classes, f"{at}/classes")

    entries = shared_entries(classes, percent, at)
    # All texts that any round compares, dealt once; the size of this list is known to Spark.
    met = materialize(entries.select(F.col("rep").alias("id")).distinct(), f"{at}/met")
    docs = materialize(docs.join(met, "id", "left_semi"), f"{at}/texts")

    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    pairs = entries.filter((F.col("rep") != F.col("leader")) & near(F.col("n"), F.col("leader_n"))).select(F.col("rep").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = materialize(pairs, f"{at}/pairs-1")
    repeated = sets.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows_of"))
    several = repeated.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("id")
    same = repeated.join(several, "id").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    links = materialize(verified(pairs, docs, words, percent).unionByName(same), f"{at}/links-1")
    roots = components(links, f"{at}/components-1")

    def placed(roots: DataFrame, name: str) -> DataFrame:
        """Entries of the buckets whose nodes are in several components."""
        own = entries.select("key", "rep", "n").join(roots.withColumnRenamed("u", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        own = materialize(own, f"{at}/{name}-placed")
        open_ = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows_of")).filter("lo < hi")
        found = materialize(looked_up(own, open_, "key", f"{at}/{name}-open").select("key", "rep", "n", "root"), f"{at}/{name}")
        for done in ("placed", "open"):
            delete(spark, f"{at}/{name}-{done}")
        return found

    # Second round: each bucket's node with most links so far.
    left = placed(roots, "left-2")
    ends = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    ranked = left.join(ends, "rep", "left").withColumn("best", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("rep")).alias("less"), "rep", "n", "root"))
    best = ranked.groupBy("key").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("rows_of")).select("key", F.col("best.rep").alias("v"), F.col("best.n").alias("vn"), F.col("best.root").alias("vroot"), "rows_of")
    second = looked_up(left, best, "key", f"{at}/best").filter((F.col("root") != F.col("vroot")) & near(F.col("n"), F.col("vn"))).select(F.col("rep").alias("u"), "v").distinct()
    second = materialize(second.join(pairs, ["u", "v"], "left_anti").join(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_anti"), f"{at}/pairs-2")
    links = materialize(verified(second, docs, words, percent), f"{at}/links-2")
    roots = components(links.unionByName(roots.select("u", F.col("root").alias("v"))), f"{at}/components-2")

    # The rest, exactly: pairs across components that aren't compared yet and may be alike enough.
    third = last_pairs(placed(roots, "left-3"), classes, docs, words, percent, f"{at}/last")
    tested = pairs.unionByName(second)
    tested = tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    third = materialize(third.join(tested, ["u", "v"], "left_anti"), f"{at}/pairs-3")
    delete(spark, f"{at}/last")
    links = materialize(verified(third, docs, words, percent), f"{at}/links-3")
    roots = components(links.unionByName(roots.select("u", F.col("root").alias("v"))), f"{at}/components-3")
    for done in ("texts", "left-2", "left-3", "best", *(f"entries-{k}" for k in range(0, tables(percent), AT_ONCE))):
        delete(spark, f"{at}/{done}")

    of_class = classes.select("digest", "rep", "rows_of").join(roots.withColumnRenamed("u", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"), "rows_of")
    full = looked_up(sets.select("digest", "id", "n_shingles"), of_class, "digest", f"{at}/of-class").select("id", "n_shingles", "component_id")
    # A document whose rows have no set beside rows that do keeps to itself in the former.
    out = full.unionByName(rows.filter("digest is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    own = lambda c: F.col(c) if free is None else F.when(F.col(c) >= free, F.col(c) + 1).otherwise(F.col(c))
    real = lambda c: F.when(F.col(c) != NO_ID, own(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), QUERY_WORDS, QUERY_PERCENT)


#: For tables whose shingles' pairs of holders can be listed, as at test size; ids must be there and unique.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 2), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * held >= 85 * (x.n + y.n - held)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, s.b FROM reached r JOIN sides s ON s.a = r.other
), roots AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)
"""
