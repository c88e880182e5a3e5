import math
import random

import numpy as np

from loomgraph.llm import language_id as L


def text_of(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def brute_bits(train, text, order):
    """Prediction by partial matching, method C with exclusions, straight from its definition."""
    tree = {}
    for t in train:
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    tree.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                    tree[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        out = set()
        for k in range(min(i, order), -1, -1):
            seen = tree.get(text[i - k : i])
            if seen is None:
                continue
            total = sum(n for b, n in seen.items() if b not in out) + len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
            out |= set(seen)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(3)
    train = {"a": [text_of(rng, "abc d", 300).encode() for _ in range(4)], "b": [text_of(rng, "bcde éü", 200).encode() for _ in range(5)], "c": [b"zz"]}
    texts = [text_of(rng, "abcdez é?", n).encode() for n in (0, 1, 2, 3, 50, 400)] + [b"\0\xff\xfe", train["a"][0]]
    for order in (0, 1, 3):
        model = L.freeze(train, order)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = L.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), starts)
        want = [[brute_bits(train[x], t, order) for x in model["languages"]] for t in texts]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    got = L.languages(held, train, limit=200_000).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got)


def test_odd(odd, clash, none):
    for docs in (odd, clash):
        got = {(r.doc_id, r.language) for r in L.languages(docs).collect()}
        assert {(3, None), (4, None), (5, None), (1, "en"), (7, "en"), (9, "en"), (None, None)} <= got
    assert L.languages(odd).count() == odd.count()
    assert L.languages(none).count() == 0
    assert {r.language for r in L.languages(odd, none).collect()} == {None}


def test_blocks_cut_nothing():
    """Scores are the same however small the blocks, at every place of cut; and 50 MB take bounded memory."""
    import tracemalloc

    rng = np.random.default_rng(8)
    train = {x: [bytes(rng.choice(list(letters), 3000).astype(np.uint8))] for x, letters in (("a", b"abcd \n"), ("b", b"bcde "))}
    model = L.freeze(train)
    texts = [bytes(rng.choice(list(b"abcdef "), n).astype(np.uint8)) for n in (0, 1, 2, 3, 4, 5, 9, 0, 30, 1, 1, 100)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = L.code_lengths(model, data, starts)
    for block in range(1, 40):
        assert np.allclose(L.code_lengths(model, data, starts, block), want, rtol=1e-5), block
    tracemalloc.start()
    L.code_lengths(model, np.resize(data, 50_000_000), np.array([0, 50_000_000]))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
