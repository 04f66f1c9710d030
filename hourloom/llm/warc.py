"""WARC archives: a normaliser for files that are one monolithic gzip stream.

``normalise`` inflates each such file once: as the stream goes by, every record is written as a gzip member of
its own to a staging archive, and a slim row tells its place, ids and digest. Then it is decided which responses
repeat an earlier payload, and the members are copied by offset into the final archive, with a sidecar index, so that
readers can fetch any record alone. Of responses with equal payloads the one with the smallest page id stays a
response; the others become revisits that refer to it (identical-payload-digest profile): their headers change where a
revisit's must, their HTTP head stays and still tells the payload's length. Only those members are inflated again, to be
written anew. All other records, of whatever type, are copied byte by byte. Payloads never pass a shuffle: only slim
rows do, dealt by file and stretch of ``STRETCH`` records, so a large file is rewritten by several tasks, each making an
archive of its own.

A task holds one record and a buffer at a time. Files have names of their own for each attempt and
are known only through the rows that a finished task returned, so lost executors leave at most
files that nobody reads; the folder is deleted with the session.

Defined results: a null html is an empty payload; a null url has no target; pages with equal ids
or ties are ordered by where they were first written; a page without id comes after those with
one; a file without records gives no archive; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import files
from hourloom.llm.common import delete, frugal, materialize, shared_dir, ship, shuffle_partitions, table

#: A monolithic file is closed after so many inflated bytes or records.
FILE_BYTES, FILE_RECORDS = 256 << 20, 50_000
#: Consecutive records of one file that one archive holds.
STRETCH = 4096
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:hourloom:page:"
#: What zlib calls a gzip header and trailer.
GZIP = 31


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None = None) -> bytes:
    """One WARC record with its two closing line breaks; a revisit's payload is empty."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def inflate(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated stream of one gzip member, or of several one after another."""
    z = zlib.decompressobj(GZIP)
    for part in parts:
        while part:
            if out := z.decompress(part, 4 << 20):
                yield out
            if z.eof:
                part, z = z.unused_data, zlib.decompressobj(GZIP)
            else:
                part = z.unconsumed_tail
    if rest := z.flush():
        yield rest


def records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an inflated stream."""
    for head, block in raw_records(parts):
        yield headers_of(head), block


def headers_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def raw_records(parts: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header lines as they are, block) of every record of an inflated stream."""
    data, source, ended = bytearray(), iter(parts), False

    def fill(until: int) -> bool:
        nonlocal ended
        while len(data) < until and not ended:
            if (part := next(source, None)) is None:
                ended = True
            else:
                data.extend(part)
        return len(data) >= until

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0 and fill(len(data) + 1):
            pass
        if end < 0:
            if data.strip():
                raise ValueError("a WARC file ends inside a record's headers")
            return
        head = bytes(data[:end])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        start = end + 4
        stop = start + int(headers_of(head)["content-length"])
        if not fill(stop + 4):
            raise ValueError("a WARC file ends inside a record")
        yield head, bytes(data[start:stop])
        del data[: stop + 4]


def page_of(name: str) -> int | None:
    found = re.fullmatch(rf"<{NAME}(-?\d+)>", name)
    return int(found[1]) if found else None


def payload_of(block: bytes) -> tuple[bytes, int]:
    """Payload, and the length that its HTTP headers tell."""
    head, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
    return payload, int(told[1]) if told else len(payload)


def is_response(headers: dict[str, str], block: bytes) -> bool:
    """Whether the block is an HTTP response whose payload may be left to another record."""
    return headers.get("warc-type") == "response" and block.startswith(b"HTTP/") and b"\r\n\r\n" in block and "warc-segment-number" not in headers


def as_revisit(head: bytes, block: bytes, sha1: str, refers_to: str, target: str | None, date: str | None) -> tuple[bytes, bytes]:
    """Header lines and block of a response as a revisit; lines that a revisit has no other value for stay as they are."""
    lines, drop = [], False
    for line in head.split(b"\r\n"):
        name = line.partition(b":")[0].strip().lower()
        if not line.startswith((b" ", b"\t")):  # a folded line goes with its first
            drop = name in (b"warc-payload-digest", b"warc-block-digest", b"content-length")
        if drop:
            continue
        lines.append(b"WARC-Type: revisit" if name == b"warc-type" else line)
    http = block[: block.index(b"\r\n\r\n") + 4]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}".encode(), f"WARC-Profile: {PROFILE}".encode(), f"WARC-Refers-To: {refers_to}".encode()]
    if target is not None:
        lines.append(f"WARC-Refers-To-Target-URI: {target}".encode())
    if date is not None:
        lines.append(f"WARC-Refers-To-Date: {date}".encode())
    return b"\r\n".join([*lines, f"Content-Length: {len(http)}".encode()]), http


def write_monolithic(pages: DataFrame, at: str) -> DataFrame:
    """Write every page as a response; rows (file, records) of the files, each one gzip stream."""
    ship(pages.sparkSession)
    folder = f"{at}/monolithic"

    @frugal
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    name, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = files.create(name), zlib.compressobj(1, zlib.DEFLATED, GZIP)
                payload = (html or "").encode()
                raw = record("response", page_id, url, payload, digest(payload), len(payload))
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if n >= FILE_RECORDS or size >= FILE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return materialize(given.mapInArrow(write, "file string, records long"), f"{at}/monolithic-files")


def spread(rows: DataFrame) -> DataFrame:
    """A partition for each row of a list of files."""
    return rows.repartition(max(1, rows.count()))


#: What is known of a record: where its member is staged, and what decides on revisits. ``target`` and ``date`` may be null; digest of responses only.
PLACES = pa.schema([
    ("file", pa.string()), ("staged", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("told", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("name", pa.string()), ("target", pa.string()), ("date", pa.string()),
])
_PLACES = "file string, staged string, ordinal long, offset long, length long, kind string, page_id long, told string, payload_bytes long, payload_digest string, name string, target string, date string"


def packed(head: bytes, block: bytes) -> bytes:
    """A record as a gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return z.compress(head + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def split(given: DataFrame, at: str) -> DataFrame:
    """Inflate each file once; write every record as a member to a staging archive; rows as ``PLACES``."""

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                uri, offset, found = f"{at}/staging/{uuid.uuid4().hex}.warc.gz", 0, []
                with files.create(uri) as out:
                    for n, (head, block) in enumerate(raw_records(inflate(files.chunks(file)))):
                        headers, member = headers_of(head), packed(head, block)
                        out.write(member)
                        name = headers["warc-record-id"]
                        row = (file, uri, n, offset, len(member), headers.get("warc-type", ""), page_of(name), headers.get("warc-payload-digest", "").removeprefix("sha1:"))
                        if is_response(headers, block):
                            payload, _ = payload_of(block)
                            row += (len(payload), digest(payload), name, headers.get("warc-target-uri"), headers.get("warc-date"))
                        found.append((*row, *[None] * (len(PLACES) - len(row))))
                        offset += len(member)
                        if len(found) >= 10_000:
                            yield _batch(found, PLACES)
                            found = []
                yield _batch(found, PLACES)

    return spread(given).mapInArrow(scan, _PLACES)


def decisions(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add revisit (boolean) and what it refers to. Copies meet with partial sums; a hot payload's rows are slim."""
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "ordinal", "name", "target", "date")
    firsts = rows.filter(F.col("payload_digest").isNotNull() & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").drop("n")
    own = (F.col("first.file") == F.col("file")) & (F.col("first.ordinal") == F.col("ordinal"))
    out = rows.join(firsts, ["payload_digest", "payload_bytes"], "left").withColumn("revisit", F.coalesce(~own, F.lit(False)))
    kept = ("file", "staged", "ordinal", "offset", "length", "kind", "page_id", "revisit")
    sha1 = F.coalesce("payload_digest", "told").alias("sha1")
    return out.select(*kept, sha1, *[F.when(F.col("revisit"), F.col(f"first.{c}")).alias(f"first_{c}") for c in ("name", "target", "date")])


def normalise(given: DataFrame, at: str, least_bytes: int = 0) -> DataFrame:
    """Rewrite monolithic files (column file) record by record; rows (archive, index, records)."""
    spark = given.sparkSession
    ship(spark)
    rows = materialize(split(given, at), f"{at}/listed")
    decided = decisions(rows, least_bytes).withColumn("stretch", F.floor(F.col("ordinal") / STRETCH))
    # As many partitions as are named, whatever the slim rows weigh: the members behind them are what takes time.
    dealt = decided.repartition(shuffle_partitions(spark), "file", "stretch").sortWithinPartitions("file", "stretch", "ordinal")

    @frugal
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = source = out = index = None

        def told() -> pa.RecordBatch:
            for f in (out, index, source):
                f.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "index": [f"{name}.idx"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                if (r["file"], r["stretch"]) != last:
                    if last:
                        yield told()
                    last, name, end, n = (r["file"], r["stretch"]), f"{at}/archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    source, out, index = files.seekable(r["staged"]), files.create(name), files.create(f"{name}.idx")
                source.seek(r["offset"])
                member, kind = source.read(r["length"]), r["kind"]
                if r["revisit"]:
                    ((head, block),) = raw_records([zlib.decompress(member, GZIP)])
                    kind, member = "revisit", packed(*as_revisit(head, block, r["sha1"], r["first_name"], r["first_target"], r["first_date"]))
                out.write(member)
                page_id = r["page_id"]
                index.write(f"{end}\t{len(member)}\t{kind}\t{'' if page_id is None else page_id}\t{r['sha1']}\n".encode())
                end, n = end + len(member), n + 1
        if last:
            yield told()

    written = materialize(dealt.mapInArrow(rewrite, "archive string, index string, records long"), f"{at}/archive-files")
    delete(spark, f"{at}/staging")  # the archives' list is written: nothing reads these again
    return written


def members(archive: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a normalised archive, each fetched by its offset and inflated alone."""
    with files.seekable(archive) as f:
        left = b""
        for part in files.chunks(index):
            *lines, left = (left + part).split(b"\n")
            for line in lines:
                offset, length, *_ = line.split(b"\t")
                yield fetch(f, int(offset), int(length))


def fetch(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    f.seek(offset)
    (found,) = records([zlib.decompress(f.read(length), GZIP)])
    return found


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record; what one doesn't tell is null."""
    ship(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows: list[tuple] = []
                for headers, block in members(archive, index):
                    payload, size = payload_of(block)
                    sha1 = headers["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in headers else None
                    # Others may cut payloads off, or tell digests of another kind.
                    if headers["warc-type"] == "response" and headers["warc-record-id"].startswith(f"<{NAME}") and (len(payload) != size or digest(payload) != sha1):
                        raise ValueError(f"{archive}: a payload differs from its digest")
                    refers = headers.get("warc-refers-to")
                    rows.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), size, sha1, headers["warc-type"], refers and page_of(refers)))
                    if len(rows) >= 10_000:
                        yield _batch(rows, schema)
                        rows = []
                yield _batch(rows, schema)

    return spread(archives).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every page through a monolithic file, the normaliser and its archives."""
    at = shared_dir(spark)
    archives = normalise(write_monolithic(table(spark, sf_dir, "pages"), at), at)
    delete(spark, f"{at}/monolithic")  # the archives' list is written: nothing reads these again
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
