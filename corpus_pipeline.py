"""A training-data pipeline over ``documents``: toxic documents, repeated lines, near copies and
documents with benchmark passages go; what stays is encoded.

Each stage takes all rows its predecessor kept and, but for the last, returns the columns of
``documents``, with ``n_chars`` of the text as it is then.

Defined results: null texts pass as empty; near copies are judged row by row, so rows that share a doc_id
stay unless their texts are alike; rows without an id are near copies only of one another; an empty table gives an
empty result; other columns pass through. SQL can't express the stages (models, hashes, tokenizers), so tests compare them with brute
force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import decontamination, line_dedup, minhash, sentencepiece_codec, toxicity
from hourloom.llm.common import columns_of, delete, materialize, shared_dir, table

#: Documents of at least this score go.
TOXIC = 0.5


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one column ``doc``: no column's name can clash with a stage's own."""
    return docs.select(F.struct(*columns_of(docs.columns)).alias("doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = "toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return toxicity.scored(docs, *model, columns=tuple(docs.columns), name=name).filter(F.col(name) < TOXIC).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", *[x.alias(f"own_{c}") for x, c in zip(columns_of(others), others, strict=True)])
    out = line_dedup.dedup_lines(renamed, tuple(f"own_{c}" for c in others))
    given = {c: x for c, x in zip(others, columns_of(f"own_{c}" for c in others), strict=True)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[given[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8; the row with the smallest doc_id of each group stays."""
    at = shared_dir(spark)
    rows = whole(docs).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, f"{at}/rows")  # written, so that the keys hold
    slim = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    gone = behind(slim.filter("doc_id is not null"), f"{at}/with-id")
    if not slim.filter("doc_id is null").isEmpty():
        gone = gone.unionByName(behind(slim.filter("doc_id is null"), f"{at}/without-id"))
    return rows.join(gone, "row", "left_anti").select("doc.*")


def behind(rows: DataFrame, at: str) -> DataFrame:
    """The keys of all rows that aren't the first of their group. Rows without any word are alike only within a doc_id."""
    alike = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), at=f"{at}/alike").withColumnRenamed("doc_id", "row")
    place = F.struct("doc_id", F.xxhash64("text").alias("text"), "row")
    empty = F.col("n_shingles") == 0
    group = F.when(empty, F.coalesce(F.col("place.doc_id").cast("long"), "row")).otherwise(F.col("component_id"))
    placed = alike.join(rows.select("row", place.alias("place")), "row").select("row", "place", empty.alias("empty"), group.alias("group"))
    placed = materialize(placed, f"{at}/placed")
    delete(rows.sparkSession, f"{at}/alike")
    firsts = placed.groupBy("empty", "group").agg(F.min("place").alias("first")).select(F.col("first.row").alias("row"))
    return placed.join(firsts, "row", "left_anti").select("row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    hit = found.select("doc_id", "text_hash").distinct()
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("doc.text", F.lit(""))) == F.col("text_hash"))
    return whole(docs).join(hit, same, "left_anti").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"{at}/{name}")
    return docs
