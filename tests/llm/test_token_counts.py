import base64

import numpy as np
import pytest

from loomgraph.llm import token_counts as T

TOKENS = [bytes([b]) for b in range(256)] + [b"ab", b"\n\n", b".\n", b"the", b" the", "é".encode()]
RAW = b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(TOKENS))


def brute(text, tokens, sections, rule):
    """Each token's characters, found byte by byte; each character's section, found one by one."""
    owner = [k for k, n in enumerate(sections) for _ in range(n)]
    char_of = [k for k, c in enumerate(text) for _ in c.encode()]
    out, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for n in tokens:
        own = [owner[c] for c in sorted(set(char_of[at : at + n]))]
        at += n
        to = {"first": own[0], "last": own[-1], "majority": max(sorted(set(own)), key=own.count)}[rule]
        out[to] += 1
        crossing[to] += len(set(own)) > 1
    return out, crossing


@pytest.mark.parametrize("rule", T.RULES)
def test_attribution_against_brute_force(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        sections = rng.integers(0, 6, rng.integers(1, 30))
        text = "".join(rng.choice(list("abé日😀\n")) for _ in range(int(sections.sum())))
        total, tokens = len(text.encode()), []
        while sum(tokens) < total:
            tokens.append(min(int(rng.integers(1, 9)), total - sum(tokens)))
        n, x = T.attribute(*T.spans(text, np.array(tokens, np.int64)), sections, rule)
        assert (n.tolist(), x.tolist()) == brute(text, tokens, sections.tolist(), rule)


def test_counts_add_up(spark):
    from loomgraph.llm.queries import VOCABULARY
    from loomgraph.llm.vocabulary import encoder, read_vocabulary

    raw = read_vocabulary(VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for rule in T.RULES:
        got = T.section_tokens(docs, raw, rule).groupBy("doc_id").sum("n_tokens", "n_chars").collect()
        want = {r.doc_id: (len(encoder(raw).encode_ordinary(r.text)), len(r.text)) for r in docs.collect()}
        assert {r[0]: (r[1], r[2]) for r in got} == want


def test_given_sections_and_fields(spark):
    """Boundaries inside tokens; the separator is a token of its own or part of one."""
    rows = [(1, "the ab", "src", [3, 3, None, 99, 0, 5]), (2, "ab", None, None), (3, None, "x", [1]), (4, "", "", [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cuts array<int>")
    got = [tuple(r) for r in T.section_tokens(docs, RAW, "first", "cuts").collect()]
    assert sorted(got) == [(1, 0, 3, 1, 0), (1, 1, 2, 2, 1), (1, 2, 1, 0, 0), (2, 0, 2, 1, 0), (4, 0, 0, 0, 0)]
    fields = [tuple(r) for r in T.field_tokens(docs, RAW, ("source", "text")).collect()]
    assert sorted(fields) == [
        (1, "source", 4, 4, 0), (1, "text", 6, 3, 0), (2, "source", 1, 1, 0), (2, "text", 2, 1, 0),
        (3, "source", 2, 2, 0), (3, "text", 0, 0, 0), (4, "source", 1, 1, 0), (4, "text", 0, 0, 0),
    ]


def test_odd(odd, clash, none):
    for docs in (odd, clash):
        got = [tuple(r) for r in T.section_tokens(docs, RAW).collect()]
        assert (4, 0, 0, 0, 0) in got and not [r for r in got if r[0] == 3]
        assert sum(r[0] == 2 for r in got) == 2 and [r for r in got if r[0] == 6][0][2] == 2
    assert T.section_tokens(none, RAW).count() == 0
    with pytest.raises(ValueError):
        T.section_tokens(none, RAW, "some")
