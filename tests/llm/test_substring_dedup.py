import re

import numpy as np

from loomgraph.llm import common
from loomgraph.llm import substring_dedup as D
from tests.llm.conftest import words

SPACE = r"[ \t\n\r\f]"


def brute(rows, window):
    """Over distinct (id, text), in order of id: all windows in a set; words of windows seen before go."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i, t] = (None, 0)
            continue
        w = re.findall(rf"[^ \t\n\r\f]+", t)
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone |= set(range(p, p + window))
            seen.add(key)
        parts = re.findall(rf"{SPACE}*[^ \t\n\r\f]+", t)
        tail = re.search(rf"{SPACE}*$", t).group() if w else t
        out[i, t] = ("".join(x for k, x in enumerate(parts) if k not in gone) + tail, len(gone))
    return out


def check(docs, window):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, window)
    got = D.without_repeats(docs, window).collect()
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got], key=str) == sorted([(i, *want[i, t]) for i, t in rows], key=str)
    return got


def test_against_brute_force(make, rng):
    shared = [words(rng, 30) for _ in range(5)]
    rows = []
    for i in range(120):
        body = words(rng, rng.choice([5, 40, 300]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body))
            body[at:at] = rng.choice(shared)[rng.randrange(5) :]
        rows.append((i, rng.choice(["", " "]) + rng.choice([" ", "\n", " \t "]).join(body) + rng.choice(["", "\n"])))
    got = check(make(rows), 12)
    assert sum(r.n_removed > 0 for r in got) > 30


def test_repeats_inside_a_document(make):
    check(make([(1, "a b c d " * 40), (2, "x"), (3, "a b c d " * 3)]), 8)


def test_long_words_that_differ_in_places_a_kilobyte_apart(make, rng):
    """Two bytes of a long word change places: nothing repeats, so nothing is cut."""
    body = words(rng, 60)

    def text(at, size):
        w = ["x"] * size
        w[at] = "A"
        return " ".join([*body[:30], "".join(w), *body[30:]])

    for size in (200, 257, 2048, 5000):
        got = check(make([(1, text(5, size)), (2, text((5 + 1024) % size if size > 1029 else size - 3, size)), (3, text(5, size))]), 50)
        assert [r.n_removed > 0 for r in sorted(got)] == [False, False, True]


def test_odd(make, odd, clash, none):
    for docs in (odd.filter("doc_id IS NULL OR doc_id <> 7"), clash):
        check(docs, 2)
    assert D.without_repeats(none).count() == 0 == D.drop_repeats(none).count()
    kept = D.drop_repeats(clash, 2)
    assert kept.columns == clash.columns and kept.count() == clash.count()


def test_prefilter_sends_few_windows_and_loses_none():
    rng = np.random.default_rng(0)
    texts = [b" ".join(b"%d" % x for x in rng.integers(0, 10**9, 400)) for _ in range(40)]
    texts[30] = texts[3]
    bits, window = 16, 20
    units, parts = [], {}
    for t in texts:
        data, starts = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        _, _, h1, h2 = D.windows(data, starts, window)
        units.append((t, h1, h2))
    import pyarrow as pa

    sketched = []
    for t in texts:
        batch = pa.RecordBatch.from_arrays([pa.array([t.decode()])], ["text"])
        sketched += list(D._sketch_rows(window, bits, 2)(iter([batch])))
    table = pa.Table.from_batches(sketched)
    found = []
    for part in set(table.column("part").to_pylist()):
        import pyarrow.compute as pc

        found += D.merge(1 << (bits - 2))(table.filter(pc.equal(table.column("part"), part))).to_pylist()
    flagged = 0
    for k, (t, h1, h2) in enumerate(units):
        own = D._unit(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        flags = D._flags(h1, h2, [r for r in found if r["unit"] == own], bits)
        if k in (3, 30):
            assert flags.all(), "a repeated window is never lost"
        else:
            flagged += flags.mean() / 38
    assert flagged < 0.3
    assert D._flags(units[0][1], units[0][2], [], bits).all(), "without an answer every window is sent"


def test_words_are_hashed_in_parts(monkeypatch):
    """What is hashed at once, also within a row or with words longer than that, changes nothing; memory is a few times the words'."""
    import tracemalloc

    texts = [b"one two  three", b"", b" ", b"x" * 255 + b" " + b"y" * 256 + b" " + b"z" * 257, "naïve 日本語 café".encode(), b"two" * 300 + b" two", b"two"]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = common.words_of(data, starts, D._SPACE, 2)
    assert whole[0].tolist() == [k for k, t in enumerate(texts) for _ in t.split()]
    assert len({*zip(*whole[1].tolist())}) == len({w for t in texts for w in t.split()}), "equal words alone have equal hashes"
    for size in (1, 5, 256, 300):
        monkeypatch.setattr(common, "WORDS_AT_ONCE", size, raising=False)
        assert all((a == b).all() for a, b in zip(whole, common.words_of(data, starts, D._SPACE, 2))), size
    monkeypatch.undo()
    many = np.frombuffer(b"abcde " * (D.UNIT_BYTES // 6), np.uint8)
    tracemalloc.start()
    common.words_of(many, np.array([0, len(many)]), D._SPACE, 2)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
