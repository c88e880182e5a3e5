"""Byte-level BPE, encoded and decoded by DuckDB queries inside each partition.

Texts are cut into pieces by the vocabulary's pattern. The pieces that a Python worker hasn't met lately become rows of
(piece, position, token), bytes at first; a recursive query joins neighbours with the merge table and contracts, in each
piece and each step, the leftmost pair of the least rank, until a piece has no such pair. Decoding joins token rows with the
vocabulary and aggregates their bytes in order of position.

A worker remembers whole words too: a text may be cut before any space that a visible character follows, since no piece of
the pattern spans such a place, and most words have been seen before.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import PATTERN, ranks

#: Bytes of text, and tokens, that are worked on at once; a longer text is taken in parts.
SLICE_BYTES, SLICE_TOKENS = 4 << 20, 1 << 20
#: Words, and pieces, that a worker remembers at least, and twice as many at most.
REMEMBER = 200_000
#: Rows of state that one recursive query may make: a piece of n bytes makes about n * n / 2.
STATE_ROWS = 4 << 20
#: Bytes of a piece from which a heap does the same contractions. The recursion takes a step for each contraction and works on
#: all rows of a piece in each, so its time grows with the square of the length (README has figures).
LONG_PIECE = 512

ENCODE = """
WITH RECURSIVE state(piece, pos, prv, nxt, tok, after, done) AS (
    SELECT piece, pos, prv, nxt, tok, after, false FROM start
    UNION ALL (
        WITH pairs AS MATERIALIZED (
            SELECT piece, pos, prv, nxt, tok, after, merged FROM state LEFT JOIN merges ON l = tok AND r = after WHERE NOT done),
        least AS (
            SELECT piece, best, (best >> 30)::INT AS made, ((best >> 20) & 1023)::INT AS spot, ((best >> 10) & 1023)::INT AS left_, (best & 1023)::INT AS right_
            FROM (SELECT piece, min((merged::BIGINT << 30) | (pos << 20) | (prv << 10) | nxt) AS best FROM pairs GROUP BY piece))
        SELECT piece, pos,
               CASE WHEN prv = spot THEN left_ ELSE prv END, CASE WHEN nxt = spot THEN right_ ELSE nxt END,
               CASE WHEN prv = spot THEN made ELSE tok END, CASE WHEN nxt = spot THEN made ELSE after END, best IS NULL
        FROM pairs JOIN least USING (piece)
        WHERE best IS NULL OR pos <> spot)
)
SELECT piece, list(tok ORDER BY pos) AS ids FROM state WHERE done GROUP BY piece ORDER BY piece
"""

#: The database has one thread, so rows reach the aggregate in the order that the subquery sorts them into.
DECODE = """
SELECT doc, string_agg(body, '') AS body
FROM (SELECT doc, body FROM tokens JOIN vocabulary ON vocabulary.id = tokens.id ORDER BY doc, pos)
GROUP BY doc ORDER BY doc
"""

#: Places before the first and after the last token of a piece; a piece has fewer than 1022.
_NO_LEFT, _NO_RIGHT = 1023, 1022
#: Bytes as characters: byte 0 as U+0100, all others as the character of their number.
_FROM_ZERO, _TO_ZERO = ("\0", "Ā"), ("Ā", "\0")
_WORD_EDGE = re.compile(r" (?=\S)")


class Recent:
    """A map that forgets what hasn't been asked for lately: two generations, of which the older one goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.young.get, keys))
        if self.old:
            late = [k for k, v in enumerate(out) if v is None and keys[k] in self.old]
            for k in late:
                out[k] = self.young[keys[k]] = self.old[keys[k]]
        return out

    def add(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(zip(keys, values))


def parts_of(text: str, limit: int = SLICE_BYTES) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut where a piece of the pattern ends."""
    at = 0
    while len(text) - at > limit:
        edge = _WORD_EDGE.search(text, at + limit // 2, at + limit)
        cut = edge.start() if edge else 0
        if not edge:
            for m in _PATTERN.finditer(text, at):
                if not text[m.end() - 1].isspace():  # a run of white space is cut with a view to what follows it
                    cut = m.end()
                    if cut - at >= limit // 2:
                        break
            cut = cut or len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


_PATTERN = regex.compile(PATTERN)


class Bpe:
    """A vocabulary in an in-memory DuckDB, and the pieces that were encoded with it."""

    def __init__(self, raw: bytes):
        self.ranks = ranks(raw)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = np.array(rows, np.int32).reshape(-1, 3)
        self.db.register("given", pa.table({c: merges[:, k] for k, c in enumerate("lrm")}))
        self.db.execute("CREATE TABLE merges AS SELECT l, r, m AS merged FROM given")
        self.db.unregister("given")
        body = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "body": [t.decode("latin-1").replace(*_FROM_ZERO) for t in self.ranks]})
        self.db.register("given", body)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words, self.pieces = Recent(REMEMBER), Recent(REMEMBER)

    def _query(self, name: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table().combine_chunks()
        finally:
            self.db.unregister(name)

    def contract(self, piece: bytes) -> bytes:
        """The contractions of one piece by a heap of (rank, position)."""
        tok, n = [int(self.byte_ids[b]) for b in piece], len(piece)
        body = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(body[i] + body[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if tok[i] >= 0 else -1
            if j < 0 or self.ranks.get(body[i] + body[j]) != rank:
                continue
            tok[i], body[i], tok[j], right[i] = rank, body[i] + body[j], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (r := self.ranks.get(body[i] + body[right[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if left[i] >= 0 and (r := self.ranks.get(body[left[i]] + body[i])) is not None:
                heapq.heappush(heap, (r, left[i]))
        return np.array([t for t in tok if t >= 0], np.int32).tobytes()

    def _contract_all(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of each piece, by one recursive query."""
        lengths = np.array([len(b) for b in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tok, last = self.byte_ids[data], pos == np.repeat(lengths - 1, lengths)
        start = {
            "piece": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "pos": pos, "prv": np.where(pos == 0, np.int32(_NO_LEFT), pos - 1),
            "nxt": np.where(last, np.int32(_NO_RIGHT), pos + 1), "tok": tok, "after": np.where(last, np.int32(-1), np.append(tok[1:], np.int32(-1))),
        }
        ids = self._query("start", pa.table(start), ENCODE).column("ids").chunk(0)
        bounds, whole = ids.offsets.to_numpy().tolist(), ids.values.to_numpy().astype(np.int32).tobytes()
        return [whole[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:])]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The tokens of each piece; those that aren't remembered are encoded."""
        asked = list(dict.fromkeys(pieces))
        out = dict(zip(asked, self.pieces.find(asked)))
        new = [p for p in asked if out[p] is None]
        bodies = [p.encode() for p in new]
        short, rows = [], 0
        for k, b in enumerate(bodies):
            if len(b) > LONG_PIECE:
                out[new[k]] = self.contract(b)
                continue
            short.append(k)
            rows += len(b) * (len(b) + 1) // 2
            if rows > STATE_ROWS:
                out.update(zip([new[i] for i in short], self._contract_all([bodies[i] for i in short])))
                short, rows = [], 0
        if short:
            out.update(zip([new[i] for i in short], self._contract_all([bodies[i] for i in short])))
        self.pieces.add(new, [out[p] for p in new])
        return out

    def _tokens_of(self, words: list[str]) -> list[bytes]:
        """Tokens of each word; one that begins a text has a space before it, all others lack theirs."""
        out = self.words.find(words)
        new = [k for k, ids in enumerate(out) if ids is None]
        if not new:
            return out
        fresh = [words[k] for k in new]
        cut = [_PATTERN.findall(w[1:] if w[0] == " " else " " + w) for w in fresh]
        known = self.learn([p for c in cut for p in c])
        found = [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut]
        for k, ids in zip(new, found):
            out[k] = ids
        self.words.add(fresh, found)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after the other, and where each text's begin (the end appended)."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            tokens = np.concatenate([self.encode([p])[0] for p in parts_of(texts[0])])
            return tokens, np.array([0, len(tokens)])
        cut = [_words(t) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
        if not bounds[-1]:
            return np.zeros(0, np.int32), bounds
        coded = pa.array([p for c in cut for p in c]).dictionary_encode()
        parts = self._tokens_of(coded.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts])
        at, each = np.cumsum(size) - size, coded.indices.to_numpy()
        upto = np.concatenate(([0], np.cumsum(size[each])))
        out = flat[np.arange(upto[-1]) + np.repeat(at[each] - upto[:-1], size[each])]
        return out, upto[bounds]

    def decode(self, tokens: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes of each text's tokens; a text of very many is put together from parts."""
        out = [b""] * (len(starts) - 1)
        for i in range(0, len(tokens), SLICE_TOKENS):
            j = min(i + SLICE_TOKENS, len(tokens))
            pos = np.arange(i, j)
            doc = np.searchsorted(starts, pos, "right").astype(np.int32) - 1
            got = self._query("tokens", pa.table({"doc": doc, "pos": pos, "id": tokens[i:j]}), DECODE)
            for k, body in zip(got.column("doc").to_pylist(), got.column("body").to_pylist()):
                body = body.replace(*_TO_ZERO).encode("latin-1")
                out[k] = out[k] + body if out[k] else body
        return out


def _words(text: str) -> list[str]:
    """Words without the space before them; the first, which has none, is marked by one."""
    words = _WORD_EDGE.split(text)
    words[0] = " " + words[0]
    return words


@lru_cache(2)
def bpe(raw: bytes) -> Bpe:
    """Kept by each Python worker, for all its tasks."""
    return Bpe(raw)


def _slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Rows that hold about ``limit`` bytes of text, at least one."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _encode_rows(raw: bytes, check: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(raw)
        for batch in batches:
            for i, j in _slices(batch.column(0)):
                texts = batch.column(0).slice(i, j - i).to_pylist()
                tokens, starts = coder.encode([t or "" for t in texts])
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(tokens), mask=pa.array(null))
                out = [batch.column(1).slice(i, j - i), pa.array(np.diff(starts), mask=null), lists]
                if check:
                    back = coder.decode(tokens, starts)
                    out.append(pa.array([t is None or t.encode() == b for t, b in zip(texts, back)], mask=null))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "tokens", "round_trip"][: len(out)])

    return rows


def encode_documents(docs: DataFrame, raw: bytes, check: bool = False) -> DataFrame:
    """For each row of ``docs``: ``doc_id, n_tokens, tokens``, and with ``check`` whether decoding gives the text back.

    A null text has null for all of these; an empty text has no tokens. Strings of special tokens are ordinary text.
    A very long text is worked on in parts of about 4 MB, so that only its text and tokens are held whole. Repeated rows are
    encoded each, ties can't occur; an empty table gives an empty result; further columns of any name are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    return base.mapInArrow(_encode_rows(raw, check), f"doc_id {kind}, n_tokens bigint, tokens array<int>" + ", round_trip boolean" * check)


def _decode_rows(raw: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(raw)
        for batch in batches:
            lists = batch.column(0)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            back = coder.decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32), starts)
            texts = [None if gone else b.decode("utf-8", "replace") for gone, b in zip(null, back)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows


def decode_documents(encoded: DataFrame, raw: bytes) -> DataFrame:
    """For each row of ``encoded``: ``doc_id, text``. Null ``tokens`` give a null text, none an empty one.

    Numbers that aren't in the vocabulary, and nulls among them, add nothing; bytes that aren't UTF-8 become replacement
    characters. A very long list is decoded in parts of about a million tokens. Repeated rows are decoded each; an empty table
    gives an empty result; further columns of any name are ignored.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("tokens", "doc_id").mapInArrow(_decode_rows(raw), f"doc_id {kind}, text string")
