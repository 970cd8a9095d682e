"""Encoding of texts with a public byte-level BPE vocabulary.

Each task cuts its texts into words, keeps the distinct words it has not met yet, and has DuckDB
contract them: token-position rows join the merge table, the pairs of least rank of each word are
contracted from the left, and the recursion ends where no word has a pair left. An ordered aggregation
gives each word's ids. Texts are then put together from the words' ids, all in arrays.

A step contracts all pairs of a word's least rank that do not overlap. That is the same as one after
the other where no merge of lower or equal rank takes up the token made; of other tokens, which rank
files may have, only the leftmost pair is contracted. So a word takes as many steps as ranks are used
in it. That is still much for a word of thousands of bytes: beyond LONG_WORD bytes, the pairs of a word
wait in a queue by rank and position instead.

Nothing is shuffled, and a word is contracted once a task however often it occurs.

Defined results
    null text, empty text   an empty list, 0 tokens
    blank text              its tokens, like any other text
    special tokens          never made; their spelling in a text is ordinary text
    very long texts         encoded whole; a task works through its texts in pieces of CHUNK_BYTES,
                            a longer text being a piece of its own; so are words of any length
    repeated rows           encoded each, other columns ignored; an empty table gives no rows
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

CHUNK_BYTES = 4 << 20
#: Words that a task remembers before it starts afresh, and bytes contracted by one recursive query.
KEPT_WORDS, QUERY_BYTES = 1 << 19, 1 << 19
#: Bytes of the longest word that the recursive query contracts.
LONG_WORD = 1 << 10

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_APOSTROPHE, _BLANK = ord("'"), ord(" ")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which words begin in the code points of texts laid end to end.

    A word is a run of letters, of numbers or of other signs, with one blank before it if there is
    one; of a longer run of white space, all but the last sign is a word. The endings 's 't 're 've
    'm 'll 'd are words if no blank or other sign stands before the apostrophe. ``text_starts`` are
    the positions at which non-empty texts begin.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)  # of a text; n stands for the end
    first[text_starts] = True
    first[n] = True
    run = np.empty(n, bool)  # begins a run of one class
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:-1]
    space = kind == SPACE
    after = np.empty(n, bool)  # a blank stands before, in the same text
    after[0] = False
    np.equal(points[:-1], _BLANK, out=after[1:])
    after &= ~first[:-1]
    begins = run & (space | ~after)
    last = np.append(run[1:], True) & space & ~first[1:]  # of white space, with more text behind it
    begins |= last

    quote = np.flatnonzero((points == _APOSTROPHE) & begins & np.append(run[1:], True) & ~first[1:])
    if len(quote):
        follow = np.append(points, np.zeros(2, points.dtype))
        one = np.isin(follow[quote + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (follow[quote + 1] == ord(a)) & (follow[quote + 2] == ord(b))
        two &= ~first[np.minimum(quote + 2, n)]
        for hit, length in ((quote[one], 2), (quote[two], 3)):
            begins[hit + 1] = False
            end = hit + length
            begins[end[end < n]] = True
    return np.flatnonzero(begins)


_CONTRACT = """
WITH RECURSIVE steps(word, pos, tok, open) AS (
  SELECT word, pos, tok, true FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, tok, lead(tok) OVER w AS after, row_number() OVER w AS n
     FROM steps WHERE open WINDOW w AS (PARTITION BY word ORDER BY pos)
   ), ranked AS (
     SELECT p.word, p.pos, p.tok, p.n, m.made, m.rank, m.alone, min(m.rank) OVER (PARTITION BY p.word) AS best
     FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.after
   ), hits AS (
     SELECT word, n, alone, row_number() OVER (PARTITION BY word ORDER BY n) AS hit FROM ranked WHERE rank = best
   ), runs AS (
     SELECT word, n, alone, hit, row_number() OVER (PARTITION BY word, n - hit ORDER BY n) AS of_run FROM hits
   ), taken AS (
     SELECT word, n FROM runs WHERE CASE WHEN alone THEN hit = 1 ELSE of_run % 2 = 1 END
   )
   SELECT r.word, r.pos, CASE WHEN t.n = r.n THEN made ELSE tok END, best IS NOT NULL
   FROM ranked r LEFT JOIN taken t ON t.word = r.word AND t.n = r.n
   ANTI JOIN taken u ON u.word = r.word AND u.n = r.n - 1)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM steps WHERE NOT open GROUP BY word ORDER BY word
"""


def contract_queued(tokens: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The tokens of one word, its pairs in a queue by rank and position."""
    n = len(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tokens = list(tokens)

    def place(i: int) -> int | None:
        """Of the pair that begins at i in the queue."""
        found = merges.get((tokens[i], tokens[after[i]])) if after[i] < n else None
        return found and found[0] * n + i

    queue = [p for p in map(place, range(n)) if p is not None]
    heapq.heapify(queue)
    while queue:
        p = heapq.heappop(queue)
        i = p % n
        if tokens[i] < 0 or place(i) != p:
            continue  # one of the pair has been taken up
        j = after[i]
        tokens[i] = merges[tokens[i], tokens[j]][1]
        tokens[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (q := place(k)) is not None:
                heapq.heappush(queue, q)
    return [t for t in tokens if t >= 0]


class BpeEncoder:
    """A byte-level BPE vocabulary: a JSON file of the tokenizers library, or a rank file (``.tiktoken``)."""

    def __init__(self, path: str):
        import duckdb

        self._bytes, pairs = _rank_file(path) if path.endswith(".tiktoken") else _json_file(path)
        ids = {b: i for i, b in self._bytes.items()}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        a, b, rank, made = (np.array(c, np.int32) for c in zip(*pairs))
        least = np.full(max(ids.values()) + 1, np.iinfo(np.int32).max)
        for side in (a, b):
            np.minimum.at(least, side, rank)
        table = pa.table({"a": a, "b": b, "rank": rank, "made": made, "alone": least[made] <= rank})
        self._pairs, self._merges = pairs, {}
        self._db = duckdb.connect(config={"threads": 1})
        self._db.register("merges_in", table)
        self._db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self._db.unregister("merges_in")
        self.forget()

    def forget(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._ids, self._ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _contract_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and their number for each word."""
        if words and not self._merges:
            self._merges = {(a, b): (rank, made) for a, b, rank, made in self._pairs}
        made = [contract_queued(self.byte_id[np.frombuffer(w, np.uint8)].tolist(), self._merges) for w in words]
        return np.array([t for m in made for t in m], np.int32), np.array(list(map(len, made)), np.int64)

    def _contract(self, words: list[bytes]) -> None:
        """Adds new words with their ids."""
        long = [w for w in words if len(w) > LONG_WORD]
        words = [w for w in words if len(w) <= LONG_WORD]
        ids, counts = [self._ids], []
        at = 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and (to == at or size + len(words[to]) <= QUERY_BYTES):
                size += len(words[to])
                to += 1
            lengths = np.fromiter(map(len, words[at:to]), np.int64, to - at)
            tokens = self.byte_id[np.frombuffer(b"".join(words[at:to]), np.uint8)]
            word = np.repeat(np.arange(to - at, dtype=np.int32), lengths)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            start = pa.table({"word": word, "pos": pos.astype(np.int32), "tok": tokens})
            self._db.register("start", start)
            made = self._db.sql(_CONTRACT).to_arrow_table().column("ids").combine_chunks()
            self._db.unregister("start")
            ids.append(made.flatten().to_numpy())
            counts.append(np.diff(made.offsets.to_numpy()))
            at = to
        if long:
            made, n = self._contract_long(long)
            ids.append(made)
            counts.append(n)
        if counts:
            before = len(self._slot)
            self._slot.update((w, before + i) for i, w in enumerate([*words, *long]))
            self._ids = np.concatenate(ids)
            self._ends = np.append(self._ends, self._ends[-1] + np.cumsum(np.concatenate(counts)))

    def encode(self, texts: pa.Array, only_counts: bool = False) -> pa.Array:
        """Lists of ids, or their lengths; null and empty texts give an empty list."""
        texts = texts.cast(pa.string()).fill_null("")
        out = [self._encode(texts.slice(at, n), only_counts) for at, n in slices(texts, CHUNK_BYTES)]
        kind = pa.int32() if only_counts else pa.list_(pa.int32())
        return pa.concat_arrays(out) if out else pa.array([], kind)

    def _encode(self, texts: pa.Array, only_counts: bool) -> pa.Array:
        offsets = _offsets(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each code point
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = offsets[:-1][np.diff(offsets) > 0]
        begins = lead[word_starts(points, np.searchsorted(lead, starts))] if len(points) else lead
        bounds = np.append(begins, len(raw)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        distinct = [w.encode() for w in words.dictionary.to_pylist()]
        if len(self._slot) > KEPT_WORDS:
            self.forget()
        self._contract([w for w in distinct if w not in self._slot])
        slots = np.fromiter((self._slot[w] for w in distinct), np.int64, len(distinct))
        slot = slots[words.indices.to_numpy()] if len(distinct) else np.empty(0, np.int64)
        begin, count = self._ends[slot], self._ends[slot + 1] - self._ends[slot]
        upto = np.append(0, np.cumsum(count))
        ends = upto[np.searchsorted(begins, offsets)]
        if only_counts:
            return pa.array(np.diff(ends).astype(np.int32))
        ids = self._ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


def _json_file(path: str) -> tuple[dict[int, bytes], list[tuple[int, int, int, int]]]:
    """The bytes of each id, and the merges as (left, right, rank, made)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]
    # special tokens are written with signs that stand for no byte
    return {i: bytes(byte.get(c, 0) for c in s) for s, i in vocab.items()}, pairs


def _rank_file(path: str) -> tuple[dict[int, bytes], list[tuple[int, int, int, int]]]:
    """The same of a rank file: any two tokens that make up a third may merge, at the third's rank."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pairs = [
        (ids[t[:k]], ids[t[k:]], i, i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids
    ]
    return {i: t for t, i in ids.items()}, pairs


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of texts of at most ``size`` bytes; a longer text is a run of its own."""
    ends, at = _offsets(texts), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, to - at
        at = to


@lru_cache(maxsize=2)
def encoder(path: str) -> BpeEncoder:
    """The encoder of a vocabulary file, once for each Python worker."""
    return BpeEncoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, name: str, only_counts: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        made = enc.encode(batch.column(batch.num_columns - 1), only_counts)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, made], [*batch.schema.names[:-1], name])


def encode(df: DataFrame, keep: list[str], text: Column, vocabulary: str, name: str = "ids", only_counts: bool = False) -> DataFrame:
    """The columns ``keep`` and, as ``name``, the ids of ``text``, or their number (``only_counts``).

    ``vocabulary`` is the path of the vocabulary file, readable on every executor.
    """
    from pyspark.sql import types as T

    if name in keep:
        raise ValueError(f"{name} is among the kept columns")
    kind = T.IntegerType() if only_counts else T.ArrayType(T.IntegerType(), False)
    kept = df.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])
    return df.select(*keep, text.cast("string").alias("_text")).mapInArrow(
        lambda it: _encoded(it, vocabulary, name, only_counts), schema
    )
