import base64

import numpy as np
import pytest

from loomgraph.llm import packing as P


@pytest.fixture(scope="session")
def raw():
    """A small vocabulary: all bytes, and a few merges."""
    tokens = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b" w", b"th", b"the", b" the"]
    return b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(tokens))


def brute(vectors, limits):
    """The heuristic as it is defined: every open choice compared, one example at a time."""
    left = sorted(range(len(vectors)), key=lambda i: tuple(-x for x in vectors[i]))
    left = [i for i in left if all(v <= c for v, c in zip(vectors[i], limits))]
    mean = [sum(vectors[i][d] / limits[d] for i in left) / max(1, len(left)) for d in range(3)]
    bins = []
    while left:
        room, own = list(limits), []
        while True:
            best, value = None, -1.0
            for i in left:
                if all(v <= r for v, r in zip(vectors[i], room)):
                    score = sum(vectors[i][d] / limits[d] * (mean[d] * room[d] / limits[d]) for d in range(3))
                    if score > value + 1e-12:
                        best, value = i, score
            if best is None:
                break
            left.remove(best)
            own.append(best)
            room = [r - v for r, v in zip(room, vectors[best])]
        bins.append(own)
    return bins


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_heuristic_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    v = np.stack((rng.integers(0, 120, 150), rng.integers(1, 3, 150), rng.integers(0, 90, 150)), axis=1)
    bins, places = P.pack_group(v, (100, 6, 80))
    want = brute(v.tolist(), (100, 6, 80))
    got = {}
    for i in range(len(v)):
        got.setdefault(bins[i], []).append((places[i], i))
    fit = [b for b in range(len(want))]
    assert [[v[i].tolist() for _, i in sorted(got[b])] for b in fit] == [[v[i].tolist() for i in b] for b in want]
    assert all(len(got[b]) == 1 for b in got if b >= len(want)) and len(v) == sum(map(len, got.values()))


def check(df, limits, key="doc_id"):
    rows, bins = df.collect(), {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        assert sorted(r.position for r in own) == list(range(len(own)))
        sums = [sum(r[c] for r in own) for c in ("n_tokens", "n_segments", "n_loss")]
        assert all(s <= c for s, c in zip(sums, limits)) or (len(own) == 1 and own[0].oversize)
    return rows, bins


def test_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(t), 1, int(t * s)) for i, (t, s) in enumerate(zip(rng.integers(1, 900, 3000), rng.random(3000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, n_segments bigint, n_loss bigint")
    got, bins = check(P.pack(df, "doc_id", (2048, 16, 1500), group=500), (2048, 16, 1500))
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert sum(r[1] for r in rows) / (2048 * len(bins)) > 0.85


def test_all_alike_and_null(spark):
    df = spark.createDataFrame([(None, None, 1, None)] * 50 + [(None, 10, 1, 5)] * 200, "doc_id bigint, n_tokens bigint, n_segments bigint, n_loss bigint")
    got, _ = check(P.pack(df, "doc_id", (100, 8, 100), group=10), (100, 8, 100))
    assert len(got) == 250
    assert P.pack(df.limit(0), "doc_id").count() == 0


def test_documents(odd, clash, none, raw):
    for docs in (odd, clash):
        got, _ = check(P.pack_documents(docs, raw, (4000, 4, 4000)), (4000, 4, 4000))
        assert len(got) == docs.count()
        assert {r.doc_id for r in got if r.oversize} == {7, 8}
        assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {P.SEPARATORS}
    assert P.pack_documents(none, raw).count() == 0


def test_conversations(spark, raw):
    turns = [(1, 0, "user", "abc the"), (1, 1, "assistant", "the w"), (1, 1, "assistant", "the w"), (2, 0, None, None), (None, 0, "assistant", "ab"), (None, 1, "user", "")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_tokens, r.n_segments, r.n_loss) for r in P.conversation_examples(df, raw).collect()}
    assert got == {1: (2 + 2 + 2 + 3, 1, 6), 2: (1, 1, 0), None: (2 + 1, 1, 2)}
    check(P.pack_conversations(df, raw), P.LIMITS, "conv_id")
