"""Token counts of a document's fields or sections, from one encoding of the whole document.

A document is encoded once; the byte lengths of its tokens, mapped to characters, give each token's span. Sections are spans
of characters too: the lines of a text, sections that begin at given offsets, or fields that were joined to one document. The
two lists are joined by interval. Most tokens lie in one section. One that crosses boundaries is allocated by an explicit
rule, so the sections' counts always add up to the document's:

``majority``  to the section that holds most of its characters, the earlier one of equals
``first``     to the section that holds its first character
``last``      to the section that holds its last character

A token of part of a character's bytes spans that character, so it never crosses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import encoder, token_bytes

RULES = ("majority", "first", "last")
#: Rows whose sections are sent on together.
AT_ONCE = 512


def line_lengths(text: str) -> np.ndarray:
    """Characters of each line with its break; an empty text has one empty line, and a break at the end begins no other."""
    lengths = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    lengths[-1] -= 1
    return lengths[:-1] if len(lengths) > 1 and not lengths[-1] else lengths


def given_lengths(text: str, begins: list[int | None] | None) -> np.ndarray:
    """Characters of each section, where ``begins`` has the places at which further ones begin: in any order, those outside the
    text, nulls and repeated ones passed over."""
    inner = sorted({b for b in begins or () if b is not None and 0 < b < len(text)})
    return np.diff(np.array([0, *inner, len(text)], np.int64))


def spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token, from the tokens' numbers of bytes."""
    stops = np.cumsum(sizes)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return stops - sizes, stops - 1
    char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64) - 1
    return char[stops - sizes], char[stops - 1]


def attribute(first: np.ndarray, last: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """From spans of tokens and lengths of sections: tokens allocated to each section, and those of them that cross a boundary."""
    ends = np.cumsum(sections)
    begin, end = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
    crossing = np.flatnonzero(begin != end)
    to = end.copy() if rule == "last" else begin.copy()
    if rule == "majority":
        for k in crossing.tolist():
            edges = np.clip(ends[begin[k] : end[k] + 1], None, last[k] + 1)
            to[k] = begin[k] + int(np.diff(edges, prepend=first[k]).argmax())
    n = len(sections)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def _section_rows(raw: bytes, rule: str, lengths: Callable[[str, object], np.ndarray], names: list[str] | None):
    """Rows of ``text, doc_id, given`` to those of sections; ``names`` stand for the sections' numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(raw).encode_ordinary, token_bytes(raw)
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                row, number, length, count, crossing = [], [], [], [], []
                some = batch.slice(i, AT_ONCE)
                for k, (text, given) in enumerate(zip(some.column(0).to_pylist(), some.column(2).to_pylist())):
                    if text is None:
                        continue
                    sections = lengths(text, given)
                    n, x = attribute(*spans(text, sizes[np.array(encode(text), np.int64)]), sections, rule)
                    row.append(np.full(len(n), k))
                    number.append(np.arange(len(n)))
                    length.append(sections)
                    count.append(n)
                    crossing.append(x)
                if row:
                    which = pa.array(np.concatenate(number))
                    if names is not None:
                        which = pa.array(names, pa.string()).take(which)
                    columns = [pa.array(np.concatenate(c)) for c in (length, count, crossing)]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(1).take(pa.array(np.concatenate(row))), which, *columns], ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"]
                    )

    return rows


def _counted(docs: DataFrame, base: DataFrame, raw: bytes, rule: str, lengths: Callable, names: list[str] | None = None) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        _section_rows(raw, rule, lengths, names), f"doc_id {kind}, section {'bigint' if names is None else 'string'}, n_chars bigint, n_tokens bigint, n_crossing bigint"
    )


def section_tokens(docs: DataFrame, raw: bytes, rule: str = "majority", begins: str | None = None) -> DataFrame:
    """For each section of each row: ``doc_id, section`` (from 0), ``n_chars, n_tokens, n_crossing``.

    Sections are the lines of the text, or begin where the column ``begins`` (an array of character offsets) says so.
    ``n_tokens`` follows the rule above; ``n_crossing`` of them cross a boundary. A null text has no sections; an empty
    text has one, without tokens. A very long text is encoded whole. Repeated rows and rows with a null id are counted
    each. An empty table gives an empty result; further columns of any name are ignored.
    """
    given = F.lit(None).cast("array<bigint>") if begins is None else F.col(begins).cast("array<bigint>")
    base = docs.select(F.col("text").cast("string").alias("text"), "doc_id", given.alias("given"))
    return _counted(docs, base, raw, rule, (lambda text, _: line_lengths(text)) if begins is None else given_lengths)


def field_tokens(docs: DataFrame, raw: bytes, fields: tuple[str, ...] = ("source", "text"), separator: str = "\n", rule: str = "majority") -> DataFrame:
    """For each of ``fields`` of each row: ``doc_id, section`` (the field's name), ``n_chars, n_tokens, n_crossing``.

    The document is the fields joined by ``separator``, which counts with the field before it; it is encoded once. A null
    field is like an empty one, so every row has all its fields. Very long texts, repeated rows, null ids, empty tables and
    further columns are as in :func:`section_tokens`.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = F.concat(*(p if k == len(parts) - 1 else F.concat(p, F.lit(separator)) for k, p in enumerate(parts)))
    sizes = F.array(*(F.length(p) + (len(separator) if k < len(parts) - 1 else 0) for k, p in enumerate(parts))).cast("array<bigint>")
    return _counted(docs, docs.select(whole.alias("text"), "doc_id", sizes.alias("given")), raw, rule, lambda _, given: np.array(given, np.int64), list(fields))
