"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts, up to ``ORDER`` bytes long, is counted on labelled texts and then frozen. A byte
is coded in the longest context that the tree knows; if the context has never been followed by it, an escape is coded
(method C: as likely as the number of different followers) and the next shorter context takes over, from which the
followers already ruled out are excluded; below the empty context all remaining byte values are alike. A text's code
length under each language is the exact sum; the shortest wins.

The frozen trees are flattened: for every n-gram that any language has seen, its code length under all languages, and for
every context what escaping from it costs (exclusions change only the divisor of the next context, so they are part of this
cost). Scoring is then array lookups, at most one for each order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_views

ORDER = 3
#: At most so many bytes of labelled texts train each language: whole texts, those whose ids hash lowest.
TRAIN_BYTES = 2 << 20
#: Bytes of text that are scored at once.
BLOCK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Rows of floats by 32-bit keys, in open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.at = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.values = np.concatenate((values, np.zeros((1, values.shape[1]), np.float32))).astype(np.float32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        self.longest = 0
        while len(todo):
            free = self.keys[slot[todo]] < 0
            place = todo[free]
            self.keys[slot[place]] = keys[place]  # of several the last stays
            won = self.keys[slot[todo]] == keys[todo]
            self.at[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.longest += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        slot = self._home(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.at[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def grams(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, and whether it lies in one row."""
    key = np.zeros(len(data), np.int64)
    for k in range(n):
        key[k:] |= data[: len(data) - k].astype(np.int64) << (8 * k)
    ok = np.ones(len(data), bool)
    for k in range(n - 1):
        at = starts[:-1] + k
        ok[at[at < starts[1:]]] = False
    return key, ok


def _statistics(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 0: the n-grams of one byte more, ascending, and their counts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out = []
    for k in range(order + 1):
        key, ok = grams(data, starts, k + 1)
        out.append(np.unique(key[ok], return_counts=True))
    return out


def freeze(texts: dict[str, list[bytes]], order: int = ORDER) -> dict:
    """The flattened trees: by order tables of n-grams (code lengths in bits) and of contexts (cost of an escape)."""
    languages = sorted(texts)
    stats = [_statistics(texts[x], order) for x in languages]
    n = len(languages)
    model: dict = {"languages": languages, "order": order, "grams": [], "escapes": []}
    for k in range(order + 1):
        seen = np.unique(np.concatenate([s[k][0] for s in stats]))
        contexts = np.unique(seen >> 8)
        cost, escape = np.full((len(seen), n), np.nan), np.zeros((len(contexts), n))
        for x, s in enumerate(stats):
            keys, counts = s[k]
            own, at = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(at, counts), np.bincount(at)
            whole = total + kinds
            cost[np.searchsorted(seen, keys), x] = -np.log2(counts / whole[at])
            if k:
                lower_keys, lower_counts = s[k - 1]
                short = keys & ((1 << 8 * k) - 1)  # the same follower after the shorter context
                ruled_out = np.bincount(at, lower_counts[np.searchsorted(lower_keys, short)])
                parents, back = np.unique(lower_keys >> 8, return_inverse=True)
                below = np.bincount(back, lower_counts) + np.bincount(back)
                divisor = below[np.searchsorted(parents, own & ((1 << 8 * (k - 1)) - 1))]
                shift = np.log2((divisor - ruled_out) / divisor)
            else:
                shift = np.log2((256.0 - kinds) / 256.0) if (kinds < 256).all() else np.zeros(1)
            escape[np.searchsorted(contexts, own), x] = -np.log2(kinds / whole) + shift
        # where one language lacks an n-gram that another has: escape, and code it one order lower
        row, x = np.nonzero(np.isnan(cost))
        lost = escape[np.searchsorted(contexts, seen[row] >> 8), x]
        if k:
            lower, table = seen[row] & ((1 << 8 * k) - 1), model["grams"][k - 1]
            cost[row, x] = lost + table.values[table.find(lower), x]
        else:
            cost[row, x] = lost + 8.0
        model["grams"].append(Table(seen, cost.astype(np.float32)))
        model["escapes"].append(Table(contexts, escape.astype(np.float32)))
    return model


def code_lengths(model: dict, data: np.ndarray, starts: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """Bits of each row under each language; memory is bounded by ``block`` bytes, however long a row is."""
    n, rows = len(model["languages"]), len(starts) - 1
    out = np.zeros((rows, n))
    for a in range(0, len(data), block):
        b, lo = min(a + block, len(data)), max(0, a - model["order"])  # a byte's context may lie in the block before
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, b, "left"))
        inner = np.concatenate(([lo], starts[first + 1 : last][starts[first + 1 : last] > lo])) if starts[first] <= lo else starts[first:last]
        inner = np.append(inner[inner >= lo], b) - lo
        if inner[0] > 0:  # bytes of an earlier row come before the block's first
            inner = np.concatenate(([0], inner))
        cost = _costs(model, data[lo:b], inner)[a - lo :]
        cut = np.clip(starts[first : last + 1], a, b) - a
        has = np.flatnonzero(np.diff(cut))
        out[first + has] += np.add.reduceat(cost, cut[:-1][has], axis=0, dtype=np.float64)
    return out


def _costs(model: dict, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each byte under each language."""
    n = len(model["languages"])
    todo = np.arange(len(data))
    cost = np.zeros((len(data), n), np.float32)
    for k in range(model["order"], -1, -1):
        if not len(todo):
            break
        key, ok = grams(data, starts, k + 1)
        key, inside = key[todo], ok[todo]
        table = model["grams"][k]
        at = np.full(len(todo), -1)
        at[inside] = table.find(key[inside])
        hit = at >= 0
        cost[todo[hit]] += table.values[at[hit]]
        left = np.flatnonzero(~hit)
        known = left[inside[left]]
        escapes = model["escapes"][k]
        cost[todo[known]] += escapes.values[escapes.find(key[known] >> 8)]
        todo = todo[left]
    cost[todo] += 8.0
    return cost


def training_texts(docs: DataFrame, limit: int = TRAIN_BYTES) -> dict[str, list[bytes]]:
    """Whole labelled texts by language: those whose ids hash lowest, as far as ``limit`` bytes go, at least one."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sized = rows.select("lang", "doc_id", F.xxhash64("text").alias("th"), F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("size"))
    # a bound on the hash leaves about ten times what is needed; it doesn't depend on how rows are spread
    totals = sized.groupBy("lang").agg(F.sum("size").alias("bytes"), F.max("size").alias("longest")).collect()
    wanted = None
    for t in totals:
        share = min(1.0, 4.0 * (limit + t["longest"]) / t["bytes"])
        part = (F.col("lang") == t["lang"]) & ((F.col("h") / 2.0**64 + 0.5) <= share)
        wanted = part if wanted is None else wanted | part
    if wanted is None:
        return {}
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1))
    picked = sized.filter(wanted).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit).select("lang", "doc_id", "th")
    got = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(picked.distinct()), ["lang", "doc_id", "th"]).select("lang", "text").collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(got):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def _language_rows(model: dict | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model["languages"] if model else [], pa.string())
        for batch in batches:
            text, n = batch.column(0), len(batch)
            best, bits, margin = np.full(n, -1), np.full(n, np.nan), np.full(n, np.nan)
            for i, j, data, starts, _ in text_views(text) if model else ():
                size = np.diff(starts)
                got = code_lengths(model, data, starts)
                best[i:j] = np.where(size > 0, got.argmin(axis=1), -1)
                two = np.sort(got, axis=1)[:, :2]
                with np.errstate(all="ignore"):
                    bits[i:j] = two[:, 0] / size
                    margin[i:j] = (two[:, -1] - two[:, 0]) / size
            none = best < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    names.take(pa.array(best, mask=none)) if model else pa.nulls(n, pa.string()),
                    pa.array(np.round(bits, 4), mask=none),
                    pa.array(np.round(margin, 4), mask=none),
                ],
                ["doc_id", "language", "bits_per_byte", "margin"],
            )

    return rows


def languages(docs: DataFrame, train: DataFrame | None = None, limit: int = TRAIN_BYTES, order: int = ORDER) -> DataFrame:
    """For each row of ``docs``: ``doc_id, language, bits_per_byte, margin`` (bits a byte to the second best).

    Trees are trained on ``train`` (default: ``docs``), by its ``lang``. A null or empty text has no language (nulls), nor
    has any without labelled texts to train on. The first language in order of names wins a tie; with one language the
    margin is 0. A very long text is scored in blocks, each byte in its whole context. Repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
    """
    texts = training_texts(docs if train is None else train, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    schema = f"doc_id {kind}, language string, bits_per_byte double, margin double"
    return base.mapInArrow(_language_rows(freeze(texts, order) if texts else None), schema)
