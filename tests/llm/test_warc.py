from __future__ import annotations

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hourloom.llm import files, warc

PAGES = [(3, "http://a/x y\nz", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (5, "http://c", ""), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (6, "u", "x" * 3_000_000), (7, "u", "solo")]


def brute(pages, least=0):
    out = []
    order = sorted(pages, key=lambda p: (p[0] is None, p[0]))
    seen = {}
    for i, _, html in order:
        raw = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = len(raw) >= least and raw in seen
        out.append((i is None, i or 0, len(raw), sha, "revisit" if again else "response", seen[raw] if again else None))
        seen.setdefault(raw, i)
    return sorted(out, key=str)


def told(rows):
    return sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.mark.parametrize("many", [1, 4])
def test_query_against_brute_force(spark, tmp_path, many, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 2 if many > 1 else 50_000)
    spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("file", F.lit("clash")).repartition(many).write.parquet(f"{tmp_path}/pages.parquet")
    assert told(warc.query(spark, str(tmp_path)).collect()) == brute(PAGES)


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    at = f"file://{tmp_path}"
    got = warc.read_archives(warc.normalise(warc.write_monolithic(pages, at), at, least_bytes=10)).collect()
    assert told(got) == brute(PAGES, 10)


def test_index_offsets_are_members(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    at = f"file://{tmp_path}"
    mono = warc.write_monolithic(pages, at)
    whole = b"".join(files.chunks(mono.first().file))
    z = zlib.decompressobj(warc.GZIP)
    z.decompress(whole)
    assert z.eof and not z.unused_data  # one stream
    row = warc.normalise(mono, at).first()
    raw = b"".join(files.chunks(row.archive))
    at = 0
    for line in b"".join(files.chunks(row["index"])).splitlines():
        offset, length, kind, _, _ = line.split(b"\t")
        assert int(offset) == at
        (found,) = warc.records([zlib.decompress(raw[at : at + int(length)], warc.GZIP)])
        assert found[0]["warc-type"].encode() == kind
        at += int(length)
    assert at == len(raw)


def test_foreign_records_stay_as_they_are(spark, tmp_path):
    def raw(kind, name, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-02-03T04:05:06Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not Found\r\nX-Own: 1\r\nContent-Length: 4\r\n\r\n"
    uri = "WARC-Target-URI: http://a/"
    given = [
        raw("warcinfo", "0", b"software: other\r\n"), raw("request", "1", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", uri), raw("response", "2", http + b"gone", uri, "WARC-Block-Digest: sha1:X"),
        raw("request", "3", b"GET /b HTTP/1.1\r\nHost: a\r\n\r\n", uri), raw("response", "4", http + b"gone", "WARC-IP-Address: 192.0.2.1", "WARC-Block-Digest: sha1:X"), raw("metadata", "5", b"via: x"), raw("metadata", "6", b"via: y"),
        raw("revisit", "7", http, "WARC-Profile: own"), raw("response", "8", b"dns: not http"), raw("resource", "9", http + b"gone"),
    ]
    source = f"file://{tmp_path}/source.warc.gz"
    with files.create(source) as f:
        f.write(zlib.compress(b"".join(given), wbits=warc.GZIP))
    only_info = f"file://{tmp_path}/info.warc.gz"
    with files.create(only_info) as f:
        f.write(zlib.compress(given[0], wbits=warc.GZIP))
    archives = warc.normalise(spark.createDataFrame([(source,), (only_info,)], "file string"), f"file://{tmp_path}/at")
    got = {r.records: (b"".join(files.chunks(r.archive)), b"".join(files.chunks(r["index"])).splitlines()) for r in archives.collect()}
    assert zlib.decompress(got[1][0], warc.GZIP) == given[0]
    packed, index = got[10]
    places = [line.split(b"\t") for line in index]
    members = [zlib.decompress(packed[int(o) : int(o) + int(n)], warc.GZIP) for o, n, *_ in places]
    assert [m for i, m in enumerate(members) if i != 4] == [g for i, g in enumerate(given) if i != 4]
    assert [p[2] for p in places] == [b"warcinfo", b"request", b"response", b"request", b"revisit", b"metadata", b"metadata", b"revisit", b"response", b"resource"]
    (again,) = warc.records([members[4]])
    sha = base64.b32encode(hashlib.sha1(b"gone").digest()).decode()
    assert again[1] == http
    assert again[0] == {
        "warc-type": "revisit", "warc-record-id": "<urn:uuid:4>", "warc-date": "2020-02-03T04:05:06Z", "warc-ip-address": "192.0.2.1", "warc-payload-digest": f"sha1:{sha}",
        "warc-profile": warc.PROFILE, "warc-refers-to": "<urn:uuid:2>", "warc-refers-to-target-uri": "http://a/", "warc-refers-to-date": "2020-02-03T04:05:06Z", "content-length": str(len(http)),
    }
    kinds = [r.record_type for r in warc.read_archives(archives).collect()]
    assert sorted(kinds) == sorted(["warcinfo", *(p[2].decode() for p in places)])


def test_each_file_is_inflated_once_and_rewritten_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 3)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    at = f"file://{tmp_path}"
    mono = warc.write_monolithic(pages, at)
    archives = warc.normalise(mono, at)
    assert sorted(r.records for r in archives.collect()) == [3, 3, 3]
    warc.delete(spark, f"{at}/monolithic")
    assert told(warc.read_archives(archives).collect()) == brute(PAGES)
    assert not (tmp_path / "staging").exists()


def test_records_across_chunk_borders():
    raw = b"".join(warc.record("response", i, "u", b"\r\n" * i, "S", 2 * i) for i in range(20))
    packed = zlib.compress(raw, wbits=warc.GZIP)
    for step in (1, 7, 1000):
        got = list(warc.records(warc.inflate(packed[i : i + step] for i in range(0, len(packed), step))))
        assert [warc.payload_of(b)[0] for _, b in got] == [b"\r\n" * i for i in range(20)]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records([raw[:-9]]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.query(spark, str(tmp_path)).count() == 0
