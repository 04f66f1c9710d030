"""Canonical exact digests: Unicode, case and white-space folding, wide xxhash, byte comparison.

Two texts are the same when their canonical forms are equal byte for byte. The fingerprint is a
128-bit xxhash of the canonical form (two 64-bit hashes with independent seeds); rows are grouped
by it, and inside a bucket of several rows the canonical bytes themselves decide, so a hash
collision splits into numbered variants. Only DataFrame functions are used.

Defined results: a null text counts as empty; equal texts, repeated rows and ties share a
fingerprint; rows that share a doc_id all stay, next to one another in order of their texts' hashes; rows without an id
stay too, after all others (group_id: null where no row with an id has the same text); an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import let, materialize, shared_dir, shuffle_partitions

#: Second hash seed; any fixed value other than the function's own.
SEED = 0x5EED
#: Buckets of several rows are broadcast up to this many (24 bytes each), joined by shuffle beyond.
BROADCAST_BUCKETS = 500_000


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC again, white space runs to one space, none at the ends."""

    def compose(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))

    def fold(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))

    def spaces(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"[\s\x85\p{Z}]+", " "))

    given = F.coalesce(text, F.lit(""))
    ascii_only = F.length(given) == F.octet_length(given)
    return spaces(F.when(ascii_only, F.lower(given)).otherwise(compose(fold(compose(given)))))


def wide_hash(canon: Column) -> Column:
    """Struct (h1, h2) of two 64-bit hashes of a canonical text."""
    return F.struct(F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit(SEED), canon).alias("h2"))


def as_text(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def digests(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with h1 and h2."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.select("doc_id", "text", F.inline(F.array(let(canonical(F.col("text")), wide_hash))))


def exact_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of every bucket that holds several: doc_id, h1, h2, variant, group_id (smallest doc_id
    with the same canonical bytes), n_copies. Other rows are alone in their bucket.

    Slim hashes are counted first, with partial aggregation, so a hot group costs a row for each
    task; only texts of buckets with several rows move on, to be compared byte for byte.
    """
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    counted = digests(docs).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(counted.filter("n > 1").select("h1", "h2"), f"{at}/several")
    if several.count() <= BROADCAST_BUCKETS:
        several = F.broadcast(several)
    rows = digests(docs).join(several, ["h1", "h2"], "left_semi")
    rows = rows.select("doc_id", "h1", "h2", canonical(F.col("text")).alias("canon"))
    by_bytes = rows.groupBy("h1", "h2", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n_copies"))
    in_bucket = Window.partitionBy("h1", "h2").orderBy("canon")
    by_bytes = materialize(by_bytes.withColumn("variant", F.row_number().over(in_bucket) - 1), f"{at}/groups")
    collided = by_bytes.filter("variant > 0").select("h1", "h2").distinct()
    plain = by_bytes.join(collided, ["h1", "h2"], "left_anti").drop("canon")
    clashing = by_bytes.join(collided, ["h1", "h2"], "left_semi")
    clashes = rows.join(clashing, ["h1", "h2", "canon"]).drop("canon") if not clashing.isEmpty() else None
    return plain, clashes


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id, n_copies for every row."""
    plain, clashes = exact_groups(docs)
    rows = digests(docs).drop("text")
    return _with_groups(rows, plain, clashes).select("doc_id", _label(), "group_id", "n_copies")


def _label(h1: str = "h1", h2: str = "h2") -> Column:
    variant = F.coalesce("variant", F.lit(0))
    named = as_text(F.col(h1), F.col(h2))
    return F.when(variant > 0, F.concat(named, F.lit("-"), variant)).otherwise(named).alias("fingerprint")


def _with_groups(rows: DataFrame, plain: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """Add variant, group_id and n_copies; clashes are matched by row, as their hashes don't tell."""
    out = rows.join(plain, ["h1", "h2"], "left")
    if clashes is not None:
        own = clashes.dropDuplicates(["h1", "h2", "doc_id"]).select("h1", "h2", "doc_id", *[F.col(c).alias(f"_{c}") for c in ("variant", "group_id", "n_copies")])
        out = out.join(own, ["h1", "h2", "doc_id"], "left")
        out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("variant", "group_id", "n_copies")})
    return out.withColumns({"group_id": F.coalesce("group_id", "doc_id"), "n_copies": F.coalesce("n_copies", F.lit(1).cast("long"))})


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Each row with next_<column> of the row after it in descending doc_id; after the last, the first.

    Rows are dealt to ranges of doc_id whose upper ends are ids of the table itself; a range also
    gets a copy of the row that starts the range below (the lowest: of the very first row), so one
    shuffle of the table is enough and no range waits for another. Rows with equal doc_id are
    ordered by ``columns``' hash; null ids come last.
    """
    spark = docs.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    ends = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q"), F.max("doc_id").alias("top")).first()
    cuts = sorted({*(ends.q or [])} - {ends.top})
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    own = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(own)
    starts_range = F.array_contains(bounds, F.col("doc_id"))
    first = F.col("doc_id").eqNullSafe(F.lit(ends.top).cast("long"))
    places = F.array(F.struct(own.alias("range"), F.lit(0).alias("ghost")))
    ghost = lambda at: F.array(F.struct(at.alias("range"), F.lit(1).alias("ghost")))
    none = F.array().cast("array<struct<range:int,ghost:int>>")
    places = F.concat(places, F.when(starts_range, ghost(own + 1)).otherwise(none), F.when(first, ghost(F.lit(0))).otherwise(none))
    dealt = docs.select("*", F.inline(places))
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64(*columns))
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("ghost = 0").drop("range", "ghost")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the fingerprint of each text, of its edited text, and whether they and the next agree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plain, clashes = exact_groups(docs)
    rows = with_next(digests(docs), ["text", "h1", "h2"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    # The bounds keep substring's length from falling to a negative number on empty texts.
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)

    def told(of: Column) -> Column:
        return let(canonical(of), lambda c: F.struct(*[wide_hash(c)[k].alias(f"edited_{k}") for k in ("h1", "h2")]))

    def alike(h1: str, h2: str, other: str) -> Column:
        same = (F.col("h1") == F.col(h1)) & (F.col("h2") == F.col(h2))
        return F.when(same, (canonical(F.col("text")) == canonical(F.col(other))).cast("double")).otherwise(0.0)

    rows = rows.select("*", F.inline(F.array(told(F.col("edited")))))
    slim = rows.select(
        "doc_id", "h1", "h2", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("edited_h1"), F.col("edited_h2")).alias("edited_fingerprint"),
        alike("edited_h1", "edited_h2", "edited").alias("near_edited"), alike("next_h1", "next_h2", "next_text").alias("near_next"),
    )
    out = _with_groups(slim, plain, clashes)
    return out.select("doc_id", "n_chars", "edited_sha256", _label(), "edited_fingerprint", "near_edited", "near_next", "group_id", "n_copies")
