"""Token ids in independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents as one stream of little-endian integers (16 bits
where the vocabulary allows, else 32), cut into frames that are compressed on their own. After
them come a skippable frame with the documents' index and, last, the seek table of the public
zstandard seekable format: each frame's compressed and plain size and a checksum (the low half of
the plain bytes' XXH64). A reader takes the table from the file's end, then reads and inflates
only the frames that hold the documents it wants, and checks each.

Documents are dealt by ranges of doc_id and sorted inside, so the files, in order, hold all of them
in ascending order. A task holds one frame, an index of its file's documents and a bounded cache
of words; files close after so many ids or documents. Where the vocabulary's own description says that it lower-cases,
drops white space and parts words at it (``by_words``), the library is asked once for each distinct word of a
worker's cache, not for each occurrence; with any other vocabulary it gets whole texts. Of every ``CHECKED``
documents one is encoded by the library as a whole too, and a difference stops the job.

Defined results: a null or empty text has the end id alone; rows without an id come first; repeated
rows and ties are kept, ordered by their texts' hash; an empty table gives no files; other columns
are ignored.
"""

from __future__ import annotations

import array
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.llm import files
from hourloom.llm.common import frugal, keep, materialize, shared_dir, ship, shuffle_partitions, table
from hourloom.llm.warc import spread

#: Fixed values of the public formats: skippable frames, their kinds used here, the seek table's end.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, TABLE_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Plain bytes of a frame; ids of a file; words that a task remembers.
FRAME_BYTES, FILE_IDS, CACHED_WORDS = 1 << 20, 1 << 28, 200_000
#: Documents of a file; documents of which one is checked as a whole.
FILE_DOCS, CHECKED = 1 << 20, 256
VOCABULARY, END_ID = "word_bpe_49k.json", 1
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
#: Letters, then marks that neither the splitter's apostrophe rules nor special tokens concern.
PLAIN = re.compile(r"([^\W\d_]*)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)").fullmatch
#: The public byte-level alphabet: bytes that print stand for themselves, others from 256 on, in order.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b if b in _PRINT else 256 + sum(x not in _PRINT for x in range(b)) for b in range(256)}
_loaded = keep(__name__)


def tokenizer(path: str | None):
    """The tokenizer of a vocabulary file, loaded once in each worker."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
    return _loaded[path]


def by_words(description: dict) -> bool:
    """Whether a tokenizer's description is of the kind whose words can be encoded one by one.

    It lower-cases and makes white space runs one space; its splitter drops them (all that its pattern doesn't
    match) and no match holds one; words end with a mark of their own; nothing else adds to or joins them.
    """
    normalizer, pre, model = (description.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = normalizer.get("normalizers", [normalizer]) if normalizer else []
    kinds = [x.get("type") for x in steps]
    spaces = [x for x in steps if x.get("type") == "Replace"]
    parts = pre.get("pretokenizers", [pre]) if pre else []
    cuts = [x for x in parts if x.get("type") == "Split"]
    return (
        set(kinds) <= {"NFC", "Replace", "Lowercase"} and kinds[-1:] == ["Lowercase"] and [(x.get("pattern"), x.get("content")) for x in spaces] == [({"Regex": "\\s+"}, " ")]
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"] and [(x.get("invert"), x.get("behavior")) for x in cuts] == [(True, "Removed")]
        and not parts[1].get("add_prefix_space") and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("byte_fallback")
    )


class Encoder:
    """Packed ids of whole texts; remembers words.

    The vocabulary's normaliser lower-cases and its splitter parts letters from other characters, so
    a word of letters, or of letters and then punctuation, is asked of the library's merge model
    directly, where its lower case is known to be plain; all other words go the whole way.
    """

    def __init__(self, path: str | None = None, end_id: int = END_ID) -> None:
        self.library = tokenizer(path)
        self.model = self.library.model
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.words, self.letters, self.seen = Words(self._ids), {}, 0
        self.by_words = by_words(json.loads(self.library.to_str()))

    def encode(self, text: str) -> bytes:
        """Ids of a text and the end id."""
        if not self.by_words:
            return self._library(text) + self.end
        found = self._by_words(text)
        self.seen += 1
        if self.seen % CHECKED == 1 and found[: -len(self.end)] != self._library(text):
            raise ValueError("ids of a text's words differ from the library's ids of the text")
        return found

    def _library(self, text: str) -> bytes:
        return array.array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_words(self, text: str) -> bytes:
        for known in (self.words, self.letters):
            if len(known) > CACHED_WORDS:
                known.clear()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) + self.end

    def _ids(self, word: str) -> bytes:
        m = PLAIN(word)
        if m and (ids := self._merged(m[1])) is not None:
            return ids + self._whole(m[2]) if m[2] else ids
        return self._whole(word)

    def _merged(self, word: str) -> bytes | None:
        """Ids of a word of letters, or None where its lower case isn't plain."""
        low = word.lower()
        if (ids := self.letters.get(low)) is None:
            if not low.isascii():
                if max(low) >= "\u0250" or not low.isalpha():
                    return None
                given = low.encode().decode("latin-1").translate(BYTE_LETTERS)
            else:
                given = low
            ids = self.letters[low] = array.array(self.code, [t.id for t in self.model.tokenize(given)]).tobytes()
        return ids

    def _whole(self, word: str) -> bytes:
        if (ids := self.letters.get(word)) is None:
            ids = self._library(word)
            if len(word) < 8:  # marks come again
                self.letters[word] = ids
        return ids


class Words(dict):
    """Ids of words, worked out when first asked for."""

    def __init__(self, ids: Callable[[str], bytes]) -> None:
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.ids(word)
        return found


class Writer:
    """One file: frames, the documents' index, the seek table."""

    def __init__(self, uri: str, width: int) -> None:
        self.uri, self.width, self.out = uri, width, files.create(uri)
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.buffer, self.table, self.docs, self.lengths, self.known = bytearray(), bytearray(), [], [], bytearray()
        self.frames = self.ids = 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(packed) // self.width)
        self.ids += self.lengths[-1]
        self.buffer += packed
        while len(self.buffer) >= FRAME_BYTES:
            self._frame(bytes(self.buffer[:FRAME_BYTES]))
            del self.buffer[:FRAME_BYTES]

    def _frame(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self._entry(len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)

    def _entry(self, packed: int, plain: int, checksum: int) -> None:
        self.table += ENTRY.pack(packed, plain, checksum)
        self.frames += 1

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        index = struct.pack("<IQ", self.width, len(self.docs)) + np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + bytes(self.known)
        packed = self.packer.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        self._entry(len(packed) + 8, 0, 0)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(self.table) + FOOTER.size) + self.table + FOOTER.pack(self.frames, 0x80, TABLE_END))
        self.out.close()


class Reader:
    """Documents of one file; inflates only the frames it is asked for."""

    def __init__(self, uri: str) -> None:
        self.uri, self.f = uri, files.seekable(uri)
        size = self.f.size()
        self.f.seek(size - FOOTER.size)
        n, flags, end = FOOTER.unpack(self.f.read(FOOTER.size))
        if end != TABLE_END or flags != 0x80:
            raise ValueError(f"{uri} does not end with a seek table")
        start = size - FOOTER.size - n * ENTRY.size
        self.f.seek(start)
        entries = np.frombuffer(self.f.read(n * ENTRY.size), "<u4").reshape(n, 3).astype("i8")
        self.packed, self.plain, self.sums = entries[:-1].T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.first = np.concatenate([[0], np.cumsum(self.plain)])
        self.f.seek(int(self.at[-1]) + 8)
        index = zstandard.ZstdDecompressor().decompress(self.f.read(int(entries[-1][0]) - 8))
        self.width, docs = struct.unpack_from("<IQ", index)
        self.docs = np.frombuffer(index, "<i8", docs, 12)
        self.lengths = np.frombuffer(index, "<u8", docs, 12 + 8 * docs).astype("i8")
        self.known = np.frombuffer(index, "u1", docs, 12 + 16 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.inflated: list[int] = []
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.f.seek(int(self.at[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.packed[k])), int(self.plain[k]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"{self.uri}: frame {k} differs from its checksum")
            self.inflated.append(k)
            self._last = (k, plain)
        return self._last[1]

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the document at this place of the file, unsigned 32-bit."""
        start, stop = int(self.starts[doc]) * self.width, int(self.starts[doc + 1]) * self.width
        parts, k = [], int(np.searchsorted(self.first, start, "right")) - 1
        while start < stop:
            plain, base = self.frame(k), int(self.first[k])
            parts.append(plain[start - base : stop - base])
            start, k = base + len(plain), k + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")

    def find(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the wanted documents that this file holds."""
        for k in np.flatnonzero(np.isin(self.docs, list(wanted)) & (self.known == 1)):
            yield int(self.docs[k]), self.ids(int(k))


def write(docs: DataFrame, at: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; rows (file, part, number, docs, ids) of the files, in order."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = given.repartitionByRange(shuffle_partitions(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)

    @frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _loaded:
            _loaded[path, end_id] = Encoder(path, end_id)
        encoder, part, number, out = _loaded[path, end_id], TaskContext.get().partitionId(), 0, None

        def told() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [out.uri], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "docs": [len(out.docs)], "ids": [out.ids]})

        for batch in batches:
            for k in range(0, len(batch), 64):
                few = batch.slice(k, 64)
                for doc_id, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist(), strict=True):
                    out = out or Writer(f"{at}/{uuid.uuid4().hex}.zst", encoder.kind.itemsize)
                    out.add(doc_id, encoder.encode(text))
                    if out.ids >= FILE_IDS or len(out.docs) >= FILE_DOCS:
                        yield told()
                        out, number = None, number + 1
        if out:
            yield told()

    return materialize(dealt.mapInArrow(encode, "file string, part int, number int, docs long, ids long"), f"{at}/files")


def read(written: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    ship(written.sparkSession)
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # rows: one for each file
    placed = written.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).select("file", "before")

    @frugal
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                r = Reader(uri)
                for k in range(0, len(r.docs), 10_000):
                    some = slice(k, k + 10_000)
                    sums = [zlib.crc32(r.ids(d)) for d in range(k, min(k + 10_000, len(r.docs)))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.docs[some], pa.int64(), mask=r.known[some] == 0), pa.array(r.starts[:-1][some] + before, pa.int64()), pa.array(r.lengths[some], pa.int64()), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread(placed).mapInArrow(told, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op6: every document's place and checksum, read back from the files."""
    return read(write(table(spark, sf_dir, "documents"), shared_dir(spark), path))
