"""Removal of lines that many documents repeat, found with two Bloom filters.

A line's key is the line without white space at its ends, in ASCII lower case. Keys of at least
``least_chars`` code points that at least ``least_docs`` documents hold lose all their lines
except in the largest doc_id that holds them.

The documents are first written in parts, one for each task, and every row knows its part.

1. Each task hashes its documents' keys (8 bytes for each distinct key of a document, and at most two for a
   key of one part) and deals them to segments of the hash space. A segment's task puts them into a filter of
   keys seen once and, when that already has one, into a filter of keys seen twice. Filters grow by further
   filters when full, so their error rate holds at any size; the number of segments grows with the documents, so
   that a segment's filters fit in a task.
2. The same hashes are asked of their segment's twice-filter, and those it has go back to the parts they came
   from, as one small file for each part. Lines with such hashes are suspected: only they are shuffled, with their
   full keys, to count documents exactly and choose the document that keeps them.
3. The keys that lose lines go back to the parts that hold them in the same way, and each part's texts are
   rebuilt. A false suspicion costs a row, never a line. Nothing is broadcast or sent to the driver, and texts
   are never shuffled.

Defined results: a null text counts as one empty line; a document without an id is the smallest;
rows with equal doc_id, or without one, are one document; ties can't occur; a document whose lines all go becomes
empty; an empty table gives an empty result; other columns are ignored, or pass through as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hourloom.llm import files
from hourloom.llm.common import columns_of, delete, frugal, materialize, shared_dir, ship, shuffle_partitions, stored_bytes, table, tidy

#: The contract's sizes.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Stored bytes of documents for each segment, at most.
SEGMENT_BYTES = 64 << 20
#: Keys of a segment's first filter (each further one takes twice as many), bits for a key, probes.
CAPACITY, BITS, PROBES = 1 << 16, 16, 4
#: Hashes that a task gathers before it deals them out.
GATHERED = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"
#: Odd multipliers, one for each probe; unrelated, as multiples of one another would probe together.
MIX = np.random.default_rng(PROBES).integers(0, 1 << 64, PROBES, np.uint64) | np.uint64(1)


class Bloom:
    """Bits in a power of two; a probe is the top of a product, so that halves can be folded."""

    def __init__(self, log2: int, bits: np.ndarray | None = None) -> None:
        self.log2, self.bits = log2, np.zeros(1 << log2, bool) if bits is None else bits

    def at(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes[:, None] * MIX) >> np.uint64(64 - self.log2)

    def add(self, hashes: np.ndarray) -> None:
        self.bits[self.at(hashes)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[self.at(hashes)].all(axis=1)

    def folded(self) -> Packed:
        """The smallest filter, at most an eighth full, that has at least the same keys."""
        log2, bits = self.log2, self.bits
        while log2 > 10 and (half := bits.reshape(-1, 2).any(axis=1)).mean() <= 0.125:
            log2, bits = log2 - 1, half
        return Packed(log2, np.packbits(bits, bitorder="little"))


class Packed(Bloom):
    """A filter to ask only, with eight bits in a byte."""

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.at(hashes)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & 1).astype(bool).all(axis=1)


class Seen:
    """The filters of one segment's task."""

    def __init__(self) -> None:
        self.once: list[Bloom] = []
        self.twice: list[Bloom] = []
        self.counts = [0, 0]

    def add(self, hashes: np.ndarray) -> None:
        hashes, counts = np.unique(hashes, return_counts=True)
        again = counts > 1
        for b in self.once:
            again |= b.has(hashes)
        self._put(self.twice, 1, hashes[again])
        self._put(self.once, 0, hashes[~again])

    def _put(self, filters: list[Bloom], which: int, hashes: np.ndarray) -> None:
        while len(hashes):
            room = (CAPACITY << len(filters)) - CAPACITY - self.counts[which]
            if room <= 0:
                filters.append(Bloom((CAPACITY * BITS - 1).bit_length() + len(filters)))
                continue
            part, hashes = hashes[:room], hashes[room:]
            filters[-1].add(part)
            self.counts[which] += len(part)


def keys_of(text: str | None) -> Iterator[tuple[bytes, bytes]]:
    """(line, key) of every line; bytes.lower changes ASCII letters alone."""
    for line in (text or "").encode().split(b"\n"):
        yield line, line.strip(BLANKS).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def by_part(rows: DataFrame, path: str, key: str = "part") -> None:
    """Write one folder of files for each value of ``key``."""
    with tidy(rows.sparkSession):
        rows.repartition(key).write.partitionBy(key).parquet(path)


def write_suspects(rows: DataFrame, at: str, least_chars: int) -> None:
    """Hashes of each part's keys that their segments have seen twice, below ``at``/suspects."""
    spark = rows.sparkSession
    segments = max(shuffle_partitions(spark), -(-stored_bytes(spark, f"{at}/rows") // SEGMENT_BYTES))

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[int] = []

        def told(part: int) -> pa.RecordBatch:
            hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            hashes = np.repeat(hashes, np.minimum(counts, 2))
            which = hashes % np.uint64(segments)
            order = np.argsort(which, kind="stable")
            which, starts = np.unique(which[order], return_index=True)
            packed = [x.tobytes() for x in np.split(hashes[order], starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(which.astype("i4")), pa.array([part] * len(which), pa.int32()), pa.array(packed, pa.binary())], ["segment", "part", "hashes"])

        last = None
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text"), strict=True):
                if found and (part != last or len(found) >= GATHERED):
                    yield told(last)
                    found.clear()
                last = part
                found += {xxhash.xxh3_64_intdigest(k) for _, k in keys_of(text.as_py()) if long_enough(k, least_chars)}
        if found:
            yield told(last)

    @frugal
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (r for batch in batches for r in zip(*(batch.column(c) for c in ("segment", "hashes")), strict=True))
        for segment, own in itertools.groupby(given, key=lambda r: r[0].as_py()):
            seen = Seen()
            for _, hashes in own:
                seen.add(np.frombuffer(hashes.as_buffer(), np.uint64))
            small = [b.folded() for b in seen.twice]
            yield pa.RecordBatch.from_arrays([pa.array([segment] * len(small), pa.int32()), pa.array([b.log2 for b in small], pa.int32()), pa.array([b.bits.tobytes() for b in small], pa.binary())], ["segment", "log2", "bits"])

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, twice = None, []
        for batch in batches:
            parts, kept = [], []
            for segment, part, hashes in zip(batch.column("segment").to_pylist(), batch.column("part").to_pylist(), batch.column("hashes"), strict=True):
                if segment != last:
                    read = (r for t in files.rows_in(f"{at}/twice/segment={segment}") for r in t.select(["log2", "bits"]).to_pylist())
                    last, twice = segment, [Packed(r["log2"], np.frombuffer(r["bits"], "u1")) for r in read]
                own = np.unique(np.frombuffer(hashes.as_buffer(), np.uint64))
                hit = np.zeros(len(own), bool)
                for b in twice:
                    hit |= b.has(own)
                if hit.any():
                    parts.append(part)
                    kept.append(own[hit].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kept, pa.binary())], ["part", "hashes"])

    dealt = materialize(rows.select("part", "text").mapInArrow(deal, "segment int, part int, hashes binary"), f"{at}/dealt")
    dealt = dealt.repartition(segments, "segment").sortWithinPartitions("segment")
    by_part(dealt.select("segment", "hashes").mapInArrow(build, "segment int, log2 int, bits binary"), f"{at}/twice", "segment")
    by_part(dealt.mapInArrow(ask, "part int, hashes binary"), f"{at}/suspects")


def suspected(rows: DataFrame, at: str, least_chars: int) -> DataFrame:
    """part, doc_id, key of the lines that more than one document may hold, once for each row and key."""

    @frugal
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doubt = None, set()
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for part, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if part != last:
                    read = [np.frombuffer(h, np.uint64) for t in files.rows_in(f"{at}/suspects/part={part}") for h in t.column("hashes").to_pylist()]
                    last, doubt = part, set(np.concatenate(read).tolist()) if read else set()
                own = {k for _, k in keys_of(text.as_py()) if long_enough(k, least_chars) and xxhash.xxh3_64_intdigest(k) in doubt} if doubt else ()
                for values, value in zip(out, (part, doc_id), strict=False):
                    values += [value] * len(own)
                out[2].extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "doc_id", "key"])

    return rows.select("part", "doc_id", "text").mapInArrow(pick, "part int, doc_id long, key binary")


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = (), least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text without the lost lines, n_lines (before), n_dropped, and ``columns`` of docs."""
    spark = docs.sparkSession
    ship(spark)
    at = shared_dir(spark)
    given = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.lit(0), *columns_of(columns)).alias("rest"))
    rows = materialize(given, f"{at}/rows")
    write_suspects(rows, at, least_chars)
    lines = materialize(suspected(rows, at, least_chars), f"{at}/suspected")
    holders = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    keepers = lines.groupBy("key").agg(holders.alias("docs"), F.max("doc_id").alias("keeper")).filter(F.col("docs") >= least_docs)
    by_part(lines.select("part", "key").distinct().join(keepers.select("key", "keeper"), "key"), f"{at}/lost")
    for done in ("dealt", "twice", "suspects", "suspected"):
        delete(spark, f"{at}/{done}")

    @frugal
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keeper = None, {}
        for batch in batches:
            texts, counts, dropped = [], [], []
            for part, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if part != last:
                    last, keeper = part, {k: i for t in files.rows_in(f"{at}/lost/part={part}") for k, i in zip(t.column("key").to_pylist(), t.column("keeper").to_pylist(), strict=True)}
                lines = list(keys_of(text.as_py()))
                stay = [x for x, k in lines if keeper.get(k, doc_id) == doc_id] if keeper else [x for x, _ in lines]
                texts.append(b"\n".join(stay).decode())
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
            made = [batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("rest"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "text", "rest", "n_lines", "n_dropped"])

    schema = StructType([*(given.schema[c] for c in ("doc_id", "text", "rest"))]).add("n_lines", "long").add("n_dropped", "long")
    out = rows.mapInArrow(rebuild, schema)
    return out.select("doc_id", "text", "n_lines", "n_dropped", *[F.col("rest").getField(c).alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: lines dropped from every document, and a digest of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), keepers AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, (p.key IS NOT NULL AND k.doc_id <> p.keeper) AS lost
  FROM keyed k LEFT JOIN keepers p ON k.key = p.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
