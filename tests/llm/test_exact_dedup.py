from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        if t is not None:
            groups[t].append((i is None, i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, i, 1))
        else:
            out.append((i, min(groups[t], key=lambda x: (x[0], x[1] or 0))[1], len(groups[t])))
    return sorted(out, key=str)


def check(docs):
    got = X.exact_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, r.keeper_id, r.n_copies) for r in got], key=str) == brute(rows)
    assert sum(r.keep for r in got) == len({t for _, t in rows if t is not None}) + sum(t is None for _, t in rows)
    return got


def test_odd(odd, clash, none):
    check(odd)
    check(clash)
    assert X.exact_duplicates(none).count() == 0 == X.drop_exact_duplicates(none).count()


def test_large_copies(make, rng):
    body = ["".join(rng.choice("abcd efgh\n") for _ in range(20_000)) for _ in range(6)]
    rows = [(i, body[i % 6] + ("!" if i % 4 == 3 else "")) for i in range(48)]
    check(make(rows))


def test_drop(odd, clash):
    for docs in (odd, clash):
        got = X.drop_exact_duplicates(docs)
        assert got.columns == docs.columns
        kept = sorted([(r.doc_id, (r.text or "")[:20]) for r in got.collect()], key=str)
        assert sum(t == "one two three" for _, t in kept) == 1 and (1, "one two three") in kept
        texts = [r.text for r in got.collect()]
        assert texts.count(None) == 3 and texts.count("") == 1


def test_collision_makes_a_longer_digest(make):
    docs = make([(1, "a" * 300), (2, "b" * 300), (3, "a" * 300)])
    bad = (lambda chunk: b"\0" * 16, 16)
    got = X.exact_duplicates(docs, (bad, *X.DIGESTS)).collect()
    assert {(r.doc_id, r.keeper_id) for r in got} == {(1, 1), (2, 2), (3, 1)}
    with pytest.raises(ValueError):
        X.exact_duplicates(docs, (bad,))


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 200_000, dtype=np.uint8)
    shifted = np.concatenate((np.arange(57, dtype=np.uint8), body))
    chunks = []
    for data in (body, shifted):
        ends = X.cut_points(data, np.array([0, len(data)]))
        starts = np.concatenate(([0], ends[:-1]))
        assert ends[-1] == len(data) and (np.diff(np.append(starts, len(data))) <= X.MAX_BYTES).all()
        chunks.append({data[a:b].tobytes() for a, b in zip(starts, ends)})
    assert len(chunks[0] & chunks[1]) >= 0.95 * len(chunks[0])
