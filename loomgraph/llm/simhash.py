"""Near-duplicate search: 256-bit SimHash fingerprints met at the words of a covering code.

A fingerprint sums random sign vectors of the distinct words of a text, twice, and of its distinct pairs of neighbouring
words, once; a character of three or four bytes is a word of its own, so texts without spaces are told apart by their
characters. A copy with a share p of its words changed differs in some 256 * arccos(1 - 1.2 p) / pi bits.

Two texts are *linked* if they differ in at most ``THRESHOLD`` bits; a group is a component of all links. They are found in
two passes. The first takes in what is cheap to find, so that copies of a template needn't meet each other again; the second
compares what is in different groups by then, and leaves out nothing.

First pass: 248 bits are cut into eight blocks of 31. In each block the anchors are the 2^26 words of the perfect Hamming code, whose
covering radius is 1: every block value has one anchor within it. Each fingerprint goes to all anchors within covering radius
plus block threshold, 1 + 1 = 2, which are 16. Two values at most 2 apart have a midpoint within 1 of both, whose own anchor
is within 2 of both, so they meet there. Within an anchor fingerprints are compared in full. By the pigeonhole principle all
pairs up to 8 * 2 + 7 = 23 bits apart share an anchor; of those up to ``THRESHOLD`` some don't.

Anchors that agree in their low bits form a cell; since anchors can be computed again, a fingerprint is sent once to each
cell that holds any of its anchors (10 to 14 in a block). A cell of too many fingerprints is cut into parts that meet
pair by pair. In an anchor with many members, what a member is linked to is set aside for good, and only the rest is
compared further: components stay what they are, and near copies of one template cost one comparison each.

Second pass: fingerprints are cut into groups by hash, and each two groups meet in one task. The 256 bits are cut into five
spans and each span into three fields, 15 in all; what may differ, 45 = THRESHOLD + 1, is shared out likewise. Were every span
of a pair to differ in 9 bits or more, the pair would differ in 45; so some span differs in 8 at most, and in it some field of 17
bits in 2 at most. For each field every value within 2 of a row's is looked up, and of what is there the span and then all
bits are compared. So every pair within the threshold, whatever the threshold is, is looked at. The work grows with the
square of the number of fingerprints, since a fixed share of all pairs, 3 % on invented prose, agrees in some field; README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, group_rows, keep_one, materialise, mix, remove, text_and_keys, text_views, with_keys, words_of

BITS = 256
THRESHOLD = 44
BLOCK, BLOCKS, ANCHORS = 31, 8, 16
#: A block has at least 2 ** CELL_BITS cells, and so many that one holds about CELL_ROWS fingerprints at most, since a cell has to
#: fit into a task. Small cells are compared together. What is found doesn't depend on these.
CELL_BITS, CELL_ROWS, AT_ONCE = 10, 1 << 20, 1 << 16
#: Members from which an anchor is searched by setting aside; bits of a cell's number, above which its part stands.
MANY, CELL_NUMBER = 64, 29
#: The second pass: spans, fields in each, rows of a group at most, and in how many groups a smaller table of over so many rows is
#: cut to keep tasks busy.
SPANS, FIELDS, GROUP_ROWS, GROUPS, FEW_ROWS = 5, 3, 1 << 19, 8, 4096
#: Rows and candidates at once in a task. What is found doesn't depend on these, nor on those above.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 15, 1 << 20
_WORD = np.array([(48 <= b < 58) or (65 <= b < 91) or (97 <= b < 123) or b >= 128 for b in range(256)])
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: For each byte, eight lanes of eight bits that hold its bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8).view(np.uint64).ravel()


def _sums(row: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its distinct features that have each of ``BITS`` bits, and of its features."""
    sums_of, counts = np.zeros((n, BITS), np.int32), np.zeros(n, np.int64)
    if not len(row):
        return sums_of, counts
    _, at = np.unique(mix(feature ^ (row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))), return_index=True)
    at.sort()
    row, feature = row[at], feature[at]
    counts = np.bincount(row, minlength=n)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    within = np.arange(len(row)) - np.repeat(begin[counts > 0], counts[counts > 0])
    runs = np.flatnonzero(within % 255 == 0)
    sums = np.empty((len(runs), 32), np.uint64)
    for k in range(4):
        code = mix(feature + _SALTS[k]).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            sums[:, 8 * k + b] = np.add.reduceat(_LANES[code[:, b]], runs)
    lanes = sums.view(np.uint8).reshape(len(runs), BITS).astype(np.int32)
    has = np.flatnonzero(counts)
    sums_of[has] = np.add.reduceat(lanes, np.searchsorted(row[runs], has), axis=0)
    return sums_of, counts


def fingerprints(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows x 4 uint64) and the number of distinct words of each row."""
    n = len(starts) - 1
    row, hashes, _ = words_of(data, starts, _WORD, wide=True)
    word = hashes[0]
    singles, counts = _sums(row, word, n)
    next_to = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pairs, pair_counts = _sums(row[next_to], mix(word[next_to] * np.uint64(3) + mix(word[next_to + 1])), n)
    bits = 2 * (2 * singles + pairs) > (2 * counts + pair_counts)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, 4), counts


def _masks() -> np.ndarray:
    """For each syndrome, what to add to a block value to reach its anchors; short rows repeat their first."""
    out = np.zeros((32, ANCHORS), np.int64)
    for s in range(1, 32):
        out[s, 0] = 1 << (s - 1)
        out[s, 1:] = [(1 << (p - 1)) | (1 << (q - 1)) for p in range(1, 32) for q in (p ^ s,) if p < q]
    return out


_MASKS = _masks()
_SYNDROME = np.zeros((4, 256), np.uint8)
for _i in range(BLOCK):
    _SYNDROME[_i // 8] ^= np.where(np.arange(256) >> (_i % 8) & 1, _i + 1, 0).astype(np.uint8)


def anchors(prints: np.ndarray, block: int) -> np.ndarray:
    """The anchors (rows x 16) within radius 2 of one block; for a word of the code the rest of its row is -1."""
    bits = np.zeros((len(prints), 32), np.uint8)
    bits[:, :BLOCK] = np.unpackbits(prints.view(np.uint8).reshape(len(prints), 32), axis=1, bitorder="little")[:, block * BLOCK : (block + 1) * BLOCK]
    four = np.packbits(bits, axis=1, bitorder="little")
    syndrome = _SYNDROME[0, four[:, 0]] ^ _SYNDROME[1, four[:, 1]] ^ _SYNDROME[2, four[:, 2]] ^ _SYNDROME[3, four[:, 3]]
    out = four.view(np.uint32).ravel().astype(np.int64)[:, None] ^ _MASKS[syndrome]
    out[syndrome == 0, 1:] = -1
    return out


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lower = pc.utf8_lower(batch.column(0))
        for i, j, data, starts, _ in text_views(lower):
            prints, counts = fingerprints(data, starts)
            blank = counts == 0
            cols = [pa.array(prints[:, k].view(np.int64), pa.int64(), mask=blank) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, *(c.slice(i, j - i) for c in batch.columns[1:])], ["f0", "f1", "f2", "f3", *batch.schema.names[1:]])


def _cell_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _matrix(batch, 0)
            for k in range(BLOCKS):
                at = anchors(prints, k)
                cells = np.sort(np.where(at < 0, at[:, :1], at) & ((1 << bits) - 1), axis=1)
                new = np.ones(cells.shape, bool)
                new[:, 1:] = cells[:, 1:] != cells[:, :-1]
                row, col = np.nonzero(new)
                ids = cells[row, col] | (k << bits)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(c.take(pa.array(row)) for c in batch.columns)], ["cell", "f0", "f1", "f2", "f3"])

    return rows


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.ascontiguousarray(np.stack([batch.column(first + k).to_numpy().view(np.uint64) for k in range(4)], axis=1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the least node of their component of the graph (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]


def matches(keys: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that share a key (``keys`` ascend) and differ in at most ``threshold`` bits."""
    left, right, at, d = [], [], np.arange(len(keys)), 0
    while True:
        d += 1
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        near = np.bitwise_count(prints[at] ^ prints[at + d]).sum(axis=1) <= threshold
        left.append(at[near])
        right.append(at[near] + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def set_aside(prints: np.ndarray, threshold: int, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of all pairs of rows that differ in at most ``threshold`` bits."""
    left, right, rest = [], [], np.arange(len(prints))
    while len(rest) > 1:
        todo, rest = rest[:1], rest[1:]
        while len(todo) and len(rest):
            some, todo = todo[:at_once], todo[at_once:]
            found = np.full(len(rest), -1)
            for x in some.tolist():
                open_ = np.flatnonzero(found < 0)
                found[open_[np.bitwise_count(prints[rest[open_]] ^ prints[x]).sum(axis=1) <= threshold]] = x
            new = found >= 0
            left.append(found[new])
            right.append(rest[new])
            todo, rest = np.concatenate((todo, rest[new])), rest[~new]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def cell_edges(cells: np.ndarray, prints: np.ndarray, threshold: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of ``prints``, all those of some cells of one block, that connect whatever meets at one of their anchors."""
    at = anchors(prints, int(cells[0]) >> bits)
    row, col = np.nonzero((at >= 0) & ((at ^ cells[:, None]) & ((1 << bits) - 1) == 0))
    keys = at[row, col]
    order = np.argsort(keys, kind="stable")
    row, keys = row[order], keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    few = np.repeat(size <= MANY, size)
    a, b = matches(keys[few], prints[row[few]], threshold)
    left, right = [row[few][a]], [row[few][b]]
    for i, n in zip(begin[size > MANY].tolist(), size[size > MANY].tolist()):
        a, b = set_aside(prints[row[i : i + n]], threshold)
        left.append(row[i + a])
        right.append(row[i + b])
    left, right = np.concatenate(left), np.concatenate(right)
    used = np.unique(np.concatenate((left, right)))
    a, b = forest(len(used), np.searchsorted(used, left), np.searchsorted(used, right))
    return used[a], used[b]


def _compare(threshold: int, bits: int):
    def found(parts: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells = parts & ((1 << CELL_NUMBER) - 1)
        cut = (np.diff(cells >> bits) != 0) | (np.diff(parts >> CELL_NUMBER) != 0)
        cuts = np.concatenate(([0], np.flatnonzero(cut) + 1, [len(cells)]))
        raw = prints.astype(">u8").view("V32").ravel()
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i < j:
                a, b = cell_edges(cells[i:j], prints[i:j], threshold, bits)
                yield pa.RecordBatch.from_arrays([pa.array(raw[i:j][x].tolist(), pa.binary()) for x in (a, b)], ["u", "v"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, prints = np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
        for batch in batches:
            parts = np.concatenate((parts, batch.column(0).to_numpy()))
            prints = np.concatenate((prints, _matrix(batch, 1)))
            if len(parts) >= AT_ONCE:
                whole = int(np.searchsorted(parts, parts[-1]))  # the last part may go on in the next batch
                if whole:
                    yield from found(parts[:whole], prints[:whole])
                    parts, prints = parts[whole:], prints[whole:]
        if len(parts):
            yield from found(parts, prints)

    return rows


def _shares(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def _spans(threshold: int) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """First bit, width, most bits that may differ and fields (first bit, width, most bits) of each span.

    A pair within the threshold is within the limits of some span and of some field of it: what may differ adds up to
    ``threshold`` and one less than the number of parts. A part of which nothing is asked (limit -1) is left out.
    """
    out, at = [], 0
    for width, more in zip(_shares(BITS, SPANS), _shares(threshold + 1, SPANS)):
        begins = at + np.cumsum([0, *_shares(width, FIELDS)])
        fields = zip(begins.tolist(), _shares(width, FIELDS), [m - 1 for m in _shares(more, FIELDS)])
        out.append((at, width, more - 1, [f for f in fields if f[2] >= 0]))
        at += width
    return out


def _field(prints: np.ndarray, begin: int, width: int) -> np.ndarray:
    """Some neighbouring bits, fewer than 64, of each fingerprint."""
    word, bit = divmod(begin, 64)
    out = prints[:, word] >> np.uint64(bit)
    if bit + width > 64:
        out |= prints[:, word + 1] << np.uint64(64 - bit)
    return out & np.uint64((1 << width) - 1)


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(width), r)]


def merge(prints: np.ndarray, label: np.ndarray, split: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between labels that connect those of all pairs of a row before ``split`` and one from it on (0: of all pairs of
    rows) that differ in at most ``threshold`` bits. Rows of one label are connected already; labels are 0, 1, ..."""
    n, count = len(prints), int(label.max()) + 1
    merged, left, right = np.arange(count), [], []

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        if not len(x):
            return
        new = merged[label[x]] != merged[label[y]]
        x, y = x[new], y[new]
        near = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1) <= threshold
        if near.any():
            left.append(x[near])
            right.append(y[near])
            if sum(map(len, left)) > PAIRS_AT_ONCE:
                take_in()

    def take_in() -> None:
        nonlocal merged
        if left:
            a, b = forest(count, merged[label[np.concatenate(left)]], merged[label[np.concatenate(right)]])
            to = np.arange(count)
            to[a] = b
            merged = to[merged]
            left.clear()
            right.clear()

    for begin, width, most, fields in _spans(threshold):
        span = _field(prints, begin, width)
        for at, bits, radius in fields:
            value, masks, now = _field(prints, at, bits).astype(np.int64), _ball(bits, radius), merged[label]
            a, b = np.arange(split or n), np.arange(split, n)
            a = a[np.lexsort((now[a], value[a]))]
            b = b[np.argsort(value[b], kind="stable")]
            place = np.arange(len(b)) - np.searchsorted(value[b], value[b])
            # the first row of each value, the second, and so on, stand in tables that hold one row for each value
            full = 0
            while len(rows := b[place == full]) > (1 << bits) // 32:
                full += 1
                table, row_of = np.full(1 << bits, (1 << 64) - (1 << width), np.uint64), np.full(1 << bits, -1)
                table[value[rows]], row_of[value[rows]] = span[rows], rows
                for i in range(0, len(a), ROWS_AT_ONCE):
                    some = a[i : i + ROWS_AT_ONCE]
                    values, spans = value[some], span[some]
                    for mask in masks:
                        hit = np.flatnonzero(np.bitwise_count(table[values ^ mask] ^ spans) <= most)
                        if len(hit):
                            y = row_of[values[hit] ^ mask]
                            keep(some[hit[y >= 0]], y[y >= 0])
            rest = b[place >= full]
            if len(rest):
                from_, keys, spans = np.searchsorted(value[a], np.arange((1 << bits) + 1)), value[a] * n + now[a], span[a]
                of_rest = now[rest], span[rest]
                for mask in masks:
                    for x, y in _looked_up(rest, value[rest] ^ mask, *of_rest, a, from_, keys, n, spans, most):
                        keep(x, y)
            take_in()
    moved = np.flatnonzero(merged != np.arange(count))
    return moved, merged[moved]


def _looked_up(rows, values, label, words, a, from_, keys, stride, spans, most) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one of ``rows`` and one of ``a`` of the value given, whose spans are near.

    ``a`` ascends by ``keys``: value times ``stride``, and label. Where many have a value, those of the row's own label are passed over as a whole.
    """
    lo, hi = from_[values], from_[values + 1]
    at = np.flatnonzero(lo < hi)
    lo, hi = lo[at], hi[at]
    many = np.flatnonzero(hi - lo > MANY)
    if len(many):
        own = values[at[many]] * stride + label[at[many]]
        begin, end = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
        at, lo, hi = np.concatenate((at, at[many])), np.concatenate((lo, end)), np.concatenate((hi, hi[many]))
        hi[many] = begin
    order = np.argsort(lo - hi)
    at, lo, size = at[order], lo[order], (hi - lo)[order]
    words, d = words[at], 0
    while True:  # the first of each range, the second, and so on, while there are many
        k = int(np.searchsorted(-size, -d))
        if k < 256:
            break
        hit = np.flatnonzero(np.bitwise_count(words[:k] ^ spans[lo[:k] + d]) <= most)
        yield rows[at[hit]], a[lo[hit] + d]
        d += 1
    at, lo, size, i = at[:k], lo[:k] + d, size[:k] - d, 0
    ends = np.cumsum(size)
    while i < k:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        end = np.cumsum(size[i:j])
        to = np.arange(end[-1]) + np.repeat(lo[i:j] - end + size[i:j], size[i:j])
        hit = np.flatnonzero(np.bitwise_count(np.repeat(words[i:j], size[i:j]) ^ spans[to]) <= most)
        yield rows[at[i:j][np.searchsorted(end, hit, "right")]], a[to[hit]]
        i = j


def _merge_tile(threshold: int):
    """A task's rows are those of one tile: two groups that meet, or one that meets itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, prints, roots = [], [], []
        for batch in batches:
            own = _matrix(batch, 2)
            root = own.astype(">u8").view("V32").ravel().copy()
            has = np.flatnonzero(batch.column(6).is_valid().to_numpy(zero_copy_only=False))
            root[has] = np.frombuffer(b"".join(batch.column(6).drop_null().to_pylist()), "V32")
            groups.append(batch.column(1).to_numpy())
            prints.append(own)
            roots.append(root)
        if groups:
            group, prints = np.concatenate(groups), np.concatenate(prints)
            order = np.argsort(group, kind="stable")
            split = int(np.searchsorted(group[order], group.max()))
            names, label = np.unique(np.concatenate(roots)[order], return_inverse=True)
            a, b = merge(prints[order], label, split, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(names[x].tolist(), pa.binary()) for x in (a, b)], ["u", "v"])

    return rows


def far_edges(single: DataFrame, roots: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges between components (``node, root``) of distinct fingerprints that any link connects."""
    names = ["f0", "f1", "f2", "f3"]
    total = single.count()
    count = max(-(-total // GROUP_ROWS), min(GROUPS, -(-total // FEW_ROWS)), 1)
    marked = single.withColumn("own", _joined()).join(roots, F.col("own") == F.col("node"), "left")
    group = F.pmod(F.xxhash64(*names), F.lit(count)).cast("int")
    low, high = F.least("own_group", "other"), F.greatest("own_group", "other")
    sent = marked.select(group.alias("own_group"), *names, "root", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other"))
    sent = sent.select((high * (high + 1) / 2 + low).cast("int").alias("tile"), "own_group", *names, "root")
    return sent.repartitionById(count * (count + 1) // 2, F.col("tile")).mapInArrow(_merge_tile(threshold), "u binary, v binary")


def _joined() -> F.Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(f"f{k}"), 16, "0") for k in range(4))))


def near_edges(single: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges ``u, v`` (32-byte fingerprints) with the components of all distinct fingerprints that meet at anchors and are linked."""
    names = ["f0", "f1", "f2", "f3"]
    total = single.count()
    bits = min(26, max(CELL_BITS, (total * ANCHORS // CELL_ROWS).bit_length()))
    sent = single.mapInArrow(_cell_rows(bits), "cell bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    if total > CELL_ROWS:  # else no cell can have more
        hot = sent.groupBy(F.col("cell").alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS)
        hot = materialise(hot.select("hot", F.ceil(F.col("n") / CELL_ROWS).cast("bigint").alias("cuts")), "hot")
        own = F.pmod(F.xxhash64(*names), F.col("cuts"))
        tiles = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1), lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j))
        tile = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(tiles)).alias("tile")
        sent = sent.join(broadcast_if_small(hot), F.col("cell") == F.col("hot"), "left").select("cell", *names, tile)
        sent = sent.select(F.col("cell").bitwiseOR(F.shiftleft("tile", CELL_NUMBER)).alias("cell"), *names)
    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(threshold, bits), "u binary, v binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``u, v``) but the roots, by alternating large and small stars.

    Every round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    before, edges = None, materialise(edges.filter("u <> v"), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.col("at")).alias("m"))
        large = both.join(low, F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("at"))
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        past, edges = edges, materialise(nxt, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(past)
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_roots(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``node, root`` for each distinct fingerprint that isn't the root of its component of all links."""
    single = materialise(prints.filter("f0 IS NOT NULL").select("f0", "f1", "f2", "f3").distinct(), "distinct")
    first = components(near_edges(single, threshold))
    last = components(far_edges(single, first, threshold))
    moved = last.select(F.col("node").alias("at"), F.col("root").alias("to"))
    onward = first.join(moved, F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return onward.unionByName(last)


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    schema = with_keys(docs, "f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    prints = materialise(text_and_keys(docs).mapInArrow(_print_rows, schema), "prints")
    roots = near_roots(prints, threshold)
    own = prints.select("doc_id", "th", F.when(F.col("f0").isNotNull(), _joined()).alias("own"))
    return own.join(roots, F.col("own") == F.col("node"), "left").select(F.coalesce("root", "own").alias("same"), "doc_id", "th")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: ``doc_id, keeper_id, group_size, keep``.

    A group is a component of the graph of links: all pairs of fingerprints that differ in at most ``threshold`` of 256 bits,
    whatever it is. The keeper of a group has the least doc_id (null ids last). Equal fingerprints, so copies and repeated rows, are
    one group, and exactly one row of it is kept. A text that is null, empty or without any word has no fingerprint and is
    its own group. A very long text is read whole. An empty table gives an empty result; further columns of any name are
    ignored.
    """
    return group_rows(_grouped(docs, threshold), "group_size")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`, all columns kept as they are."""
    return keep_one(docs, _grouped(docs, threshold), "near")
