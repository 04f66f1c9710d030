"""SentencePiece encoding for merge-type vocabularies, checked against the library.

A text's symbols start as its characters; an agenda of adjacent pairs, best score first and then
leftmost, is worked off until no pair is a piece. Symbols that are no piece fall back to bytes.
No piece of the vocabulary spans the start of a new run of word marks, holds a character that only
stands alone, or has characters of two classes (letters and punctuation, say), which are read from
the pieces; so segments cut there merge independently: a segment is worked out once for each
task's bounded cache, not for each occurrence. Where a vocabulary has pieces that do span words, or
no bytes, so that unknown characters side by side have one id, whole texts are the segments.

In every Arrow batch the sentencepiece library encodes each segment that was newly worked out, and
one whole text of every ``FEW``; it decodes every text's ids, and texts that don't come back as they
were are encoded by it as wholes too. A difference stops the job; ``check=False`` leaves that out.

Defined results: a null text counts as empty and has no ids; repeated rows and ties are kept; long
texts are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import frugal, keep, ship, table

VOCABULARY = "piece_bpe_32k.model"
#: The library's mark of a space, and the segments of each of the two generations that a task remembers.
MARK, CACHED_SEGMENTS = "▁", 400_000
#: Segments of up to so many characters use the list agenda; the rank of a pair that is no piece, and of one whose score others
#: have, which becomes a symbol that stays to the end.
SHORT, NEVER, TIED = 40, 1 << 60, -1
#: Segments beyond this length aren't remembered; documents whose ids a task holds at a time.
LONGEST, FEW = 64, 64
_loaded = keep(__name__)


def codec(path: str | None = None) -> Codec:
    """The codec of a model file, loaded once in each worker, until a task of another operator starts there."""
    if path not in _loaded:
        import public_tokenizers

        _loaded[path] = Codec(path or public_tokenizers.path(VOCABULARY))
    return _loaded[path]


def classes(pieces: Iterable[str]) -> tuple[list[str], str]:
    """Characters that pieces hold beside others (or themselves), put together where pieces link them; and those that pieces
    hold beside marks only. No piece has characters of two of the former, nor two of the latter, nor of both."""
    other: dict[str, str] = {}
    led: set[str] = set()

    def of(c: str) -> str:
        while (up := other.setdefault(c, c)) != c:
            other[c] = c = other[up]
        return c

    for p in pieces:
        rest = p.replace(MARK, "")
        if len(rest) > 1:
            for c in rest:
                other[of(c)] = of(rest[0])
        elif len(p) > 1:
            led.update(rest)
    together: dict[str, str] = {}
    for c in sorted(other):
        together[of(c)] = together.get(of(c), "") + c
    return sorted(together.values(), key=len, reverse=True), "".join(sorted(led - other.keys()))


class Segments(dict):
    """Ids of segments, worked out when first asked for."""

    def __init__(self, ids: Callable[[str], tuple[int, ...]]) -> None:
        self.ids = ids
        self.new: list[str] = []
        self.old: dict[str, tuple[int, ...]] = {}

    def age(self) -> None:
        """Start anew; what is asked for again comes back from the generation before, the rest goes with it."""
        self.old = dict(self)
        self.clear()

    def __missing__(self, segment: str) -> tuple[int, ...]:
        found = self.old.get(segment)
        if found is None:
            found = self.ids(segment)
            self.new.append(segment)
        if len(segment) <= LONGEST:
            self[segment] = found
        return found


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        self.pieces = {lib.id_to_piece(i): i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.score = {p: (-lib.get_score(i)) for p, i in self.pieces.items()}
        self.names = sorted(self.pieces, key=self.score.__getitem__)
        self.placed = [self.pieces[p] for p in self.names]
        self.place = {p: k for k, p in enumerate(self.names)}
        longer = [p for p in self.names if len(p) > 1]
        alike = Counter(self.score[p] for p in longer)
        self.rank: defaultdict[int, dict[int, int]] = defaultdict(dict)
        for p in longer:
            for k in range(1, len(p)):
                if (a := self.place.get(p[:k])) is not None and (b := self.place.get(p[k:])) is not None:
                    self.rank[a][b] = self.place[p] if alike[self.score[p]] == 1 else TIED
        named = {lib.id_to_piece(i): i for i in every if lib.is_byte(i)}
        self.bytes = [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else None
        self.unknown = lib.unk_id()
        spans = any(MARK in p.lstrip(MARK) for p in self.pieces)
        several, single = classes(self.pieces)
        runs = "|".join([*(f"[{re.escape(x)}]+" for x in several), *([f"[{re.escape(single)}]"] if single else [])])
        led = rf"[ {MARK}]*(?:{runs})|" if runs else ""
        self.cut = re.compile(r".+" if spans or self.bytes is None else rf"{led}[ {MARK}]+|.", re.DOTALL).findall
        self.said = list(map(str, every))
        self.known = Segments(self.merge)

    def merge(self, segment: str) -> tuple[int, ...]:
        """Work off the agenda of one segment, with a mark for each space as the model's normaliser has it."""
        segment = segment.replace(" ", MARK)
        if len(segment) <= SHORT and (places := self._agenda(segment)) is not None:
            return tuple(map(self.placed.__getitem__, places))
        ids: list[int] = []
        for s in self._long(segment):
            if (found := self.pieces.get(s)) is not None:
                ids.append(found)
            elif self.bytes is not None:
                ids += [self.bytes[x] for x in s.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return tuple(ids)

    def _agenda(self, segment: str) -> list[int] | None:
        """The agenda as a list by place: few pairs, so its least entry is found by looking. Symbols are places in the order of
        scores, so a pair's rank is what it becomes; none where characters are no pieces, or a pair's score isn't its own."""
        rank = self.rank
        try:
            symbols = list(map(self.place.__getitem__, segment))
        except KeyError:
            return None
        agenda = [rank[a].get(b, NEVER) for a, b in itertools.pairwise(symbols)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = best
            del agenda[i], symbols[i + 1]
            if i < len(agenda):
                agenda[i] = rank[best].get(symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank[symbols[i - 1]].get(best, NEVER)
        return None if TIED in symbols else symbols

    def _short(self, segment: str) -> list[str]:
        """What the list agenda leaves, as text; by the heap where the list can't tell."""
        places = self._agenda(segment)
        return self._long(segment) if places is None else [self.names[k] for k in places]

    def _long(self, segment: str) -> list[str]:
        """The agenda as a heap, with entries that later merges have made void."""
        symbols: list[str | None] = list(segment)
        n, rank = len(symbols), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, segment[i : i + 2]) for i in range(n - 1) if (r := rank.get(segment[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(piece) or after[left] != right:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                joined = piece + symbols[nxt]
                if (r := rank.get(joined)) is not None:
                    heapq.heappush(agenda, (r, left, nxt, joined))
            if (prev := before[left]) >= 0:
                joined = symbols[prev] + piece
                if (r := rank.get(joined)) is not None:
                    heapq.heappush(agenda, (r, prev, left, joined))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the normaliser puts a space before any that isn't empty."""
        if len(self.known) > CACHED_SEGMENTS:
            self.known.age()
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, self.cut(" " + text)))) if text else []

    def check(self, doc_ids: list, texts: list[str], ids: list[list[int]], decoded: list[str]) -> None:
        """Compare with the library: new segments, the first text, and texts that changed on the way."""
        doubtful = [k for k, x in enumerate(texts) if k == 0 or decoded[k] != x.replace(MARK, " ")]
        new = "\n".join(self.known.new)
        of = [*(doc_ids[k] for k in doubtful), f"{doc_ids[0]} or after"]
        own = [*(ids[k] for k in doubtful), self.encode(new)]
        for doc_id, a, b in zip(of, own, self.library.encode([*(texts[k] for k in doubtful), new], num_threads=1), strict=True):
            if a != b:
                raise ValueError(f"document {doc_id}: own ids differ from the library's")
        self.known.new.clear()


def encoded(docs: DataFrame, path: str | None = None, check: bool = True, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row."""
    ship(docs.sparkSession)
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*kinds, ("ids", pa.list_(pa.int32()))] if with_ids else kinds)

    @frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for k in range(0, len(batch), FEW):
                few = batch.slice(k, FEW)
                texts = few.column("text").to_pylist()
                ids = [own.encode(x) for x in texts]
                decoded = own.library.decode(ids, num_threads=1)
                if check:
                    own.check(few.column("doc_id").to_pylist(), texts, ids, decoded)
                own.known.new.clear()
                said = [",".join(map(own.said.__getitem__, x)) for x in ids]
                columns = [
                    few.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))] if with_ids else columns, schema=schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return given.mapInArrow(encode, named)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: ids of every document by the agenda, checked, and what the library decodes from them."""
    return encoded(table(spark, sf_dir, "documents"), with_ids=False)
