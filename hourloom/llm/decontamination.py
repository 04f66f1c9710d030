"""Benchmark decontamination by winnowing.

A window of an item is ``span`` consecutive words (an item of fewer words is one window). Both sides
keep, of every ``span - k + 1`` consecutive k-gram hashes, the smallest: any shared run of ``span``
words contains a k-gram that both sides keep, so joining the kept hashes finds every shared
window. Each hit is then extended: all windows of the document around it are compared, word for
word, with the items' windows. Items of fewer words than ``span`` use k = their length and keep
every k-gram, which gives the same guarantee. Only DataFrame functions are used.

The benchmark's hashes are broadcast in blocks of a fixed number of rows, one pass over the
documents for each block, so nothing that is broadcast grows with either side; document texts are
never shuffled.

Defined results: a null or empty text has no words and no hits; items without words match nothing;
repeated rows and ties get equal results; items with equal texts are all named; an empty table on
either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import indices, let, lower_ascii, materialize, shared_dir, table

#: Words of a window, of a fingerprinted gram, and benchmark hashes in one broadcast (40 bytes each).
SPAN, GRAM, BLOCK = 10, 5, 1_000_000
#: Everything but letters, digits and code points above 127, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram(hashes: Column, i: Column, k: int, kind: int) -> Column:
    """Odd hash of the k words from i on; ``kind`` keeps gram lengths apart."""
    return F.xxhash64(F.lit(kind), *[F.get(hashes, i + j) for j in range(k)]).bitwiseOR(F.lit(1))


def kept(hashes: Column, kind: int, gram_words: int = GRAM, span: int = SPAN) -> Column:
    """Distinct hashes that winnowing keeps. kind: the window's length, ``span`` or a short item's."""
    k = gram_words if kind == span else kind
    grams = F.transform(indices(F.size(hashes) - (k - 1)), lambda i: gram(hashes, i, k, kind))
    w = span - k + 1 if kind == span else 1
    if w == 1:
        return F.array_distinct(grams)
    least = lambda g: F.array_distinct(F.transform(indices(F.size(g) - (w - 1)), lambda i: F.least(*[F.get(g, i + j) for j in range(w)])))
    return let(grams, least)


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def benchmark_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """key (a window's words), items (the ids that hold it)."""
    given = items.select("item_id", F.inline(F.array(F.struct(words(F.col("text")).alias("w")))))
    at = F.transform(indices(F.greatest(F.size("w") - (span - 1), F.least(F.size("w"), F.lit(1)))), lambda i: F.array_join(F.slice("w", i + 1, F.lit(span)), " "))
    windows = given.select("item_id", F.explode(F.array_distinct(at)).alias("key"))
    return windows.groupBy("key").agg(F.collect_set("item_id").alias("items"))


def benchmark_hashes(items: DataFrame, kinds: list[int], span: int = SPAN) -> DataFrame:
    """hash, kind: what winnowing keeps of every item, for the kind that its length gives."""
    given = items.select(F.inline(F.array(F.struct(words(F.col("text")).alias("w")))))
    given = given.withColumn("kind", F.least(F.size("w"), F.lit(span)))
    found = None
    for kind in kinds:
        of_kind = let(_word_hashes(F.col("w")), partial(kept, kind=kind, span=span))
        hashes = given.filter(F.col("kind") == kind).select(F.explode(of_kind).alias("hash"), F.lit(kind).alias("kind"))
        found = hashes if found is None else found.unionByName(hashes)
    return found.distinct()


def _around(kind: int, span: int = SPAN, gram_words: int = GRAM) -> Column:
    """Windows (start, n, key) of a document around the grams whose hash is ``hash``."""
    k = gram_words if kind == span else kind
    at = F.filter(indices(F.size("hashes") - (k - 1)), lambda i: gram(F.col("hashes"), i, k, kind) == F.col("hash"))
    last = F.size("w") - kind
    starts = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (kind - k), F.lit(0)), F.least(p, last))))
    return F.transform(F.array_distinct(starts), lambda s: F.struct(s.alias("start"), F.lit(kind).alias("n"), F.array_join(F.slice("w", s + 1, F.lit(kind)), " ").alias("key")))


def contamination(docs: DataFrame, items: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted item ids) and spans of every document row.

    spans: the disjoint word ranges [start, end) that windows of items cover.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    lengths = items.select(F.least(F.size(words(F.col("text"))), F.lit(span)).alias("n")).distinct()
    kinds = sorted(r.n for r in lengths.collect() if r.n)  # at most ``span`` numbers
    windows = materialize(benchmark_windows(items, span), f"{at}/windows")
    none = spark.createDataFrame([], "hash long, kind int")
    hashes = materialize(benchmark_hashes(items, kinds, span) if kinds else none, f"{at}/hashes")
    blocks = max(1, -(-hashes.count() // block))

    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = let(words(F.col("text")), lambda w: let(_word_hashes(w), lambda h: F.struct(w.alias("w"), h.alias("hashes"), F.concat(*[kept(h, kind, span=span) for kind in kinds] or [F.array().cast("array<bigint>")]).alias("kept"))))
    given = given.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(F.array(read)))
    # Hash 0 is even, so no gram has it: each row's own line in the result, joined or not.
    own = spark.createDataFrame([(0, 0)], "hash long, kind int")
    parts = []
    for b in range(blocks):
        wanted = hashes.filter(F.pmod("hash", F.lit(blocks * 2)).between(2 * b, 2 * b + 1)) if blocks > 1 else hashes
        keep = F.concat(F.array(F.lit(0).cast("long")), "kept") if b == 0 else F.col("kept")
        rows = given.select("doc_id", "text_hash", "w", "hashes", F.explode(keep).alias("hash"))
        rows = rows.join(F.broadcast(wanted.unionByName(own) if b == 0 else wanted), "hash")
        around = F.lit(None).cast("array<struct<start:int,n:int,key:string>>")
        for kind in kinds:
            around = F.when(F.col("kind") == kind, _around(kind, span)).otherwise(around)
        parts.append(rows.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "kind", around.alias("around")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = materialize(found, f"{at}/found")

    hits = found.filter("kind > 0").select("doc_id", "text_hash", F.inline("around")).distinct()
    hits = hits.join(windows, "key").select("doc_id", "text_hash", F.struct("start", (F.col("start") + F.col("n")).alias("end")).alias("at"), "items")
    hits = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def merge(spans: Column, x: Column) -> Column:
        last = F.element_at(spans, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(spans) > 0) & (F.get(spans, F.size(spans) - 1)["end"] >= x["start"]), F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(joined))).otherwise(F.concat(spans, F.array(x)))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    hits = hits.select("doc_id", "text_hash", "items", F.aggregate("at", empty, merge).alias("spans"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "items", "spans")
    out = found.filter("kind = 0").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "text_hash", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast(hits.schema["items"].dataType)).alias("items"), F.coalesce("spans", empty).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: hit words and items of every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS key
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), spots AS (
  SELECT rid, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS key
  FROM (SELECT rid, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM docs, (SELECT DISTINCT k FROM windows))
), hits AS (
  SELECT DISTINCT rid, s, k, item_id FROM spots JOIN windows USING (key, k)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""
