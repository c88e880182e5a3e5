import random
import time

import numpy as np
import pytest

from loomgraph.llm import simhash as S
from tests.llm.conftest import words


def prints_of(texts):
    data = [t.lower().encode() for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    return S.fingerprints(np.frombuffer(b"".join(data), np.uint8), starts)


def test_code_covers_every_value():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    for k in range(S.BLOCKS):
        at = S.anchors(prints, k)
        bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")[:, k * 31 : (k + 1) * 31]
        values = (bits.astype(np.int64) << np.arange(31)).sum(axis=1)
        away = np.where(at >= 0, np.bitwise_count(at ^ values[:, None]), 0)
        assert away.max() <= 2 and (np.where(at >= 0, away, 99).min(axis=1) <= 1).all()


def test_close_pairs_always_meet():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (300, 4)).astype(np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(256, 23, replace=False):
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    met = np.zeros(300, bool)
    for k in range(S.BLOCKS):
        x, y = S.anchors(a, k), S.anchors(b, k)
        met |= ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(axis=(1, 2))
    assert met.all()


def linked(prints, threshold=S.THRESHOLD):
    """All pairs within the threshold that share an anchor, by comparing everything with everything."""
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= threshold
    meet = np.zeros(near.shape, bool)
    for k in range(S.BLOCKS):
        at = S.anchors(prints, k)
        for i in np.arange(len(prints)):
            own = at[i][at[i] >= 0]
            meet[i] |= np.isin(at, own).any(axis=1)
    return near & meet


def brute_groups(rows, threshold=S.THRESHOLD):
    prints, counts = prints_of([t or "" for _, t in rows])
    has = np.flatnonzero(counts)
    near = linked(prints[has], threshold)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        before = label.copy()
        for i, row in zip(has, near):
            label[i] = label[has[row]].min()
        if (label == before).all():
            break
    return label


def near_rows(rng, bases=60):
    rows, n = [], 0
    for base in range(bases):
        body = words(rng, rng.choice([30, 200, 1500]))
        for copy in range(rng.choice([1, 2, 5])):
            out = list(body)
            for _ in range(len(out) * copy // 100):
                out[rng.randrange(len(out))] = "changed" + str(rng.randrange(10**6))
            rows.append((n, " ".join(out)))
            n += 1
    return rows


@pytest.mark.parametrize("cell_rows", [S.CELL_ROWS, 40])
def test_near_copies_against_brute_force(make, rng, monkeypatch, cell_rows):
    """No link is lost and none is made up, also where cells are cut into parts."""
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(S, "CELL_BITS", 1 if cell_rows == 40 else S.CELL_BITS)
    rows = near_rows(rng)
    label = brute_groups(rows)
    got = {r.doc_id: r for r in S.near_duplicates(make(rows)).collect()}
    assert [got[i].keeper_id for i in range(len(rows))] == label.tolist()
    assert sum(label[i] != i for i in range(len(rows))) > 40
    assert sum(r.keep for r in got.values()) == len({r.keeper_id for r in got.values()})


def whole_groups(prints, threshold=S.THRESHOLD):
    """The least row of each row's component of all pairs within the threshold, whatever they share."""
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= threshold)
    label = np.arange(len(prints))
    moved, to = S.forest(len(prints), a, b)
    label[moved] = to
    return label


@pytest.mark.parametrize("few_rows", [S.FEW_ROWS, 30])
def test_links_without_a_common_anchor(make, monkeypatch, few_rows):
    """Pairs within the threshold are linked where no block of theirs is near, too, in one task or in many."""
    monkeypatch.setattr(S, "FEW_ROWS", few_rows)
    rng, rows = random.Random(11), []
    for _ in range(80):
        body = words(rng, 120)
        for share in (0, 8, 9, 10):
            rows.append((len(rows), " ".join(w if rng.randrange(100) >= share else f"new{rng.randrange(10**6)}" for w in body)))
    prints, _ = prints_of([t for _, t in rows])
    want = whole_groups(prints)
    assert (want != brute_groups(rows)).sum() > 5, "anchors alone don't find these"
    got = {r.doc_id: r.keeper_id for r in S.near_duplicates(make(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want.tolist()
    kept = S.drop_near_duplicates(make(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.tolist()))


@pytest.mark.parametrize("threshold", [0, 7, 44, 70])
def test_merging_against_brute_force(threshold):
    """Also for other thresholds, hot values, large clusters and some rows that are connected already."""
    rng = np.random.default_rng(threshold)
    n = 400 if threshold == 70 else 1500
    prints = rng.integers(0, 2**63, (n // 3, 4)).astype(np.uint64)[rng.integers(0, n // 3, n)]
    prints[n // 2 :, 0] = prints[0, 0]
    prints[: n // 5] = prints[0]
    for i in range(n):
        for bit in rng.choice(256, rng.integers(0, threshold * 3 // 4 + 2), replace=False):
            prints[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= threshold
    for split in (0, n // 3):
        for label in (np.arange(n), np.unique(np.where(np.arange(n) < n // 10, 0, np.arange(n)), return_inverse=True)[1]):
            a, b = np.nonzero(near[: split or n, split:])
            want, got = np.arange(label.max() + 1), np.arange(label.max() + 1)
            for to, (x, y) in ((want, (label[a], label[b + split])), (got, S.merge(prints, label, split, threshold))):
                moved, root = S.forest(len(to), x, y)
                to[moved] = root
            assert got.tolist() == want.tolist()


def test_setting_aside_keeps_components():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, (40, 4)).astype(np.uint64)[rng.integers(0, 40, 600)]
    for i in range(600):
        for bit in rng.choice(256, rng.integers(0, 30), replace=False):
            prints[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    label = lambda e: {int(k): int(v) for k, v in zip(*S.forest(600, *e))}
    assert label(S.set_aside(prints, 44)) == label(S.matches(np.zeros(600), prints, 44))


def test_a_large_template_takes_bounded_time():
    rng = np.random.default_rng(6)
    prints = np.tile(rng.integers(0, 2**63, (1, 4)).astype(np.uint64), (20_000, 1))
    for k in range(3):  # up to nine bits of the last words differ, all in the seventh and eighth block
        prints[:, 3] ^= np.uint64(1) << rng.integers(8, 56, 20_000).astype(np.uint64)
    prints = np.unique(prints, axis=0)
    began = time.perf_counter()
    cell = int(S.anchors(prints[:1], 0)[0, 0]) & 1023
    a, b = S.cell_edges(np.full(len(prints), cell), prints, S.THRESHOLD, 10)
    assert len(prints) > 10_000 and len(np.unique(b)) == 1 and len(a) == len(prints) - 1
    assert time.perf_counter() - began < 20


def test_texts_without_spaces_and_in_another_order(make, rng):
    base = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(640))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(640))
    body = words(rng, 200)
    mixed = rng.sample(body, len(body))
    rows = [(1, base), (2, base[:300] + "永" + base[301:]), (3, other), (4, " ".join(body)), (5, " ".join(mixed))]
    got = {r.doc_id: r.keeper_id for r in S.near_duplicates(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_odd(odd, clash, none):
    for docs in (odd, clash):
        got = S.near_duplicates(docs).collect()
        assert len(got) == docs.count()
        assert {(r.doc_id, r.keeper_id, r.group_size) for r in got if r.doc_id in (1, 2)} == {(1, 1, 4), (2, 1, 4)}
        assert all(r.keep and r.group_size == 1 for r in got if r.doc_id in (3, 4, 5, 6, 10))
        kept = S.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and kept.filter("text = 'one two three'").count() == 1
        assert kept.filter("text IS NULL").count() == 3 and kept.filter("text = ''").count() == 2
    assert S.near_duplicates(none).count() == 0 == S.drop_near_duplicates(none).count()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(300)], "u binary, v binary")
    got = S.components(edges).collect()
    assert len(got) == 300 and {bytes(r.root) for r in got} == {b"\0\0"}
