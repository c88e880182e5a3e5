import base64
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe as B
from loomgraph.llm.queries import VOCABULARY
from loomgraph.llm.vocabulary import PATTERN, encoder, ranks, read_vocabulary

RAW = read_vocabulary(VOCABULARY)


def naive(piece, known):
    """Contract the leftmost pair of the least rank until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((known.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [known[p] for p in parts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_round_trip_and_public_encoder(texts):
    coder = B.bpe(RAW)
    tokens, starts = coder.encode(texts)
    for t, a, b in zip(texts, starts[:-1], starts[1:]):
        assert tokens[a:b].tolist() == encoder(RAW).encode_ordinary(t)
    assert coder.decode(tokens, starts) == [t.encode() for t in texts]


def test_heap_and_query_contract_alike():
    rng, known = random.Random(0), ranks(RAW)
    coder = B.bpe(RAW)
    pieces = ["".join(rng.choice("aabcdeilnorst") for _ in range(n)) for n in (1, 2, 5, 30, 80, 400, 3000)]
    got = coder.learn(pieces)
    for p in pieces:
        want = naive(p.encode(), known)
        assert list(memoryview(got[p]).cast("i")) == want
        assert list(memoryview(coder.contract(p.encode())).cast("i")) == want


def test_parts_are_cut_where_pieces_end():
    rng, coder = random.Random(1), B.bpe(RAW)
    bits = ["a", " ", "\n", "  ", "\t", " \n", "日本", "é", "'s", "12", "!?", "\x1c", "\x85", "\xa0", "word", " b", "\u2003"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        want = encoder(RAW).encode_ordinary(text)
        for limit in (1000, 9, 4):
            parts = list(B.parts_of(text, limit))
            assert "".join(parts) == text
            assert [t for p in parts for t in coder.encode([p])[0].tolist()] == want


def test_a_text_of_50_mb():
    rng = random.Random(2)
    some = [f"word{i} plain text, {i}\n" for i in range(5000)]
    text = "".join(rng.choice(some) for _ in range(2_300_000)) + "ac" * 1500 + "日本語" * 300_000
    assert len(text.encode()) > 50_000_000
    coder = B.bpe(RAW)
    tokens, starts = coder.encode([text])
    assert coder.decode(tokens, starts) == [text.encode()]
    assert tokens[:200_000].tolist() == encoder(RAW).encode_ordinary(text[:2_000_000])[:200_000]


def test_what_was_asked_for_lately_stays():
    r = B.Recent(2)
    for k in "abcd":
        r.add([k], [k.encode()])
        assert r.find(["a"]) == [b"a"]
    assert r.find(["b", "d"])[1] == b"d" and len(r.young) + len(r.old) <= 6


def test_another_vocabulary():
    """Ranks where a pair made late outranks earlier ones, and ties lie side by side."""
    tokens = [bytes([b]) for b in range(256)] + [b"aa", b"aaa", b"ba", b"aab", b"\0a"]
    raw = b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(tokens))
    want = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks(raw), special_tokens={})
    texts = ["aaaa aaaaa", "baaab", "\0a\0aa", "abaab" * 30, "a" * 3000]
    tokens, starts = B.Bpe(raw).encode(texts)
    assert [tokens[a:b].tolist() for a, b in zip(starts, starts[1:])] == [want.encode_ordinary(t) for t in texts]


def test_odd(odd, clash, none):
    for docs in (odd, clash):
        got = B.encode_documents(docs, RAW, check=True)
        rows = got.collect()
        assert len(rows) == docs.count()
        assert all(r.tokens is None and r.n_tokens is None and r.round_trip is None for r in rows if r.doc_id == 3)
        assert all(r.tokens == [] and r.n_tokens == 0 for r in rows if r.doc_id in (4, 5))
        assert all(r.round_trip for r in rows if r.tokens is not None)
        back = B.decode_documents(got, RAW).collect()
        assert sorted((str(r.doc_id), r.text or "") for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert B.encode_documents(none, RAW).count() == 0 == B.decode_documents(B.encode_documents(none, RAW), RAW).count()
