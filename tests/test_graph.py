import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import resolve, search, traverse
from loomgraph.operators.graph import Graph, GraphStore
from loomgraph.plans import schema

FILE = "id string, path string, language string, content_hash string, size_bytes bigint, indexed_at timestamp"


def symbol(i, name, full=None, kind="FUNCTION", file="f", parent=None):
    return (i, name, full or f"module.{name}", kind, "python", file, 1, 5, "", parent, "", False)


def edge(i, source, target, kind="CALLS", resolution="resolved", **metadata):
    return (i, source, target, kind, ("f", 3, 0), resolution, metadata)


@pytest.fixture(scope="module")
def make(spark):
    def of(symbols=(), edges=(), files=(("f", "/a.py", "python", "abc123", 10, None),)):
        return Graph(spark.createDataFrame(list(files), schema.FILES), spark.createDataFrame(list(symbols), schema.SYMBOLS), spark.createDataFrame(list(edges), schema.RELATIONSHIPS))

    return of


def test_store(spark, make, tmp_path):
    store = GraphStore(spark, tmp_path.as_uri())
    assert store.schema_version() == "1" and store.graph().symbols.count() == 0
    store.store(make([symbol("a", "fa"), symbol("b", "fb")], [edge("e", "a", "b"), edge("u", "a", "", resolution="unresolved", target_name="x")]))
    g = store.graph()
    e = g.relationships.filter("id = 'e'").first()
    assert (e.source_location.line, e.source_location.col, e.metadata) == (3, 0, {})
    assert g.relationships.filter("id = 'u'").first().metadata == {"target_name": "x"}
    store.update(spark.createDataFrame([("u", "b", "probable"), ("none", "b", "resolved")], "id string, target_id string, resolution string"))
    assert store.graph().relationships.filter("id = 'u'").select("target_id", "resolution").first() == ("b", "probable")
    store.store(make([symbol("a", "other", file="g"), symbol("c", "fc", file="g")], [edge("e", "c", "b")], [("g", "/a.py", "python", "new", 11, None)]))
    g = store.graph()
    f = g.files.collect()
    assert [(x.id, x.content_hash) for x in f] == [("f", "new")], "a known path keeps its id"
    assert {r.id: (r.name, r.file_id) for r in g.symbols.collect()} == {"a": ("fa", "f"), "b": ("fb", "f"), "c": ("fc", "f")}
    assert g.relationships.filter("id = 'e'").first().source_id == "a", "a known id is left alone"
    store.clear()
    assert store.graph().files.count() == 0 and store.schema_version() == "1"
    assert GraphStore(spark, tmp_path.as_uri()).schema_version() == "1"
    store.close()


def test_update_one_and_delete(make):
    g = make([symbol("a", "a"), symbol("b", "b", parent="a", file="g"), symbol("c", "c", file="g", parent=None)], [edge("e", "a", "")])
    assert G.update_relationship(g.relationships, "e", "b", "probable").first().target_id == "b"
    d = G.delete_files(g, g.files.select("id"))
    assert d.files.count() == 0 and {(r.id, r.parent_id) for r in d.symbols.collect()} == {("b", None), ("c", None)}


def test_domains(make):
    s, r = schema.check_domains(make([symbol("a", "a")]).symbols, make([], [edge("e", "a", "b")]).relationships)
    assert s.count() == 1 == r.count()
    bad, _ = schema.check_domains(make([symbol("a", "a", kind="ODD")]).symbols, r)
    with pytest.raises(Exception, match="unknown kind"):
        bad.collect()


def test_location(spark):
    rows = spark.createDataFrame([("f", 3, None), ("f", 0, 1), (None, 3, 1), ("f", None, 1)], "f string, l int, c int")
    got = [r[0] for r in rows.select(schema.location(F.col("f"), F.col("l"), F.col("c"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("f", 3, 0), None, None, None]


def brute(edges, known, start, types, direction, depth):
    """Level by level with full rows, as the recursion is defined; then the filter, then the least depths."""
    pairs = set()
    for s, t, k in edges:
        if t and direction in ("out", "both"):
            pairs.add((s, t, k))
        if t and direction in ("in", "both"):
            pairs.add((t, s, k))
    after = defaultdict(set)
    for s, t, k in pairs:
        after[s].add((t, k))
    level, rows = {(None, start, 0, None)}, []
    for d in range(1, depth + 1):
        level = {(w[1], t, d, k) for w in level for t, k in after[w[1]]}
        rows += [r for r in level if not types or r[3] in types]
    nodes, found = {}, {}
    for f, t, d, k in rows:
        if t != start and t in known:
            nodes[t] = min(nodes.get(t, (99, "", "")), (d, k, f))
        e = (t, f, k) if direction == "in" else (f, t, k)
        if e[0] in known and e[1] in known:
            found[e] = min(found.get(e, 99), d)
    return {(t, d, k) for t, (d, k, _) in nodes.items()}, {(*e, d) for e, d in found.items()}


@pytest.mark.parametrize("seed", range(4))
def test_walks_against_plain_search(make, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice([*names, "", "gone"]), rng.choice(["CALLS", "IMPORTS", "CONTAINS"])) for _ in range(26)]
    g = make([symbol(n, n) for n in names], [edge(f"e{i}", *e) for i, e in enumerate(edges)])
    for direction, types, depth in [("out", None, 3), ("in", ["CALLS"], 4), ("both", ["IMPORTS", "CONTAINS"], 3), ("out", [], 1)]:
        nodes, found = brute(edges, set(names), "n0", types, direction, depth)
        for engine in ("loop", "cte"):
            got = traverse.walk(g, "n0", types, direction, depth, engine=engine).collect()
            assert {(r.id, r.depth, r.via) for r in got} == nodes and len(got) == len(nodes)
        assert {tuple(r) for r in traverse.walk_edges(g, "n0", types, direction, depth).collect()} == found


def test_walk_limits(make):
    g = make([symbol(n, n) for n in "abc"], [edge("1", "a", "b", "CONTAINS"), edge("2", "b", "c"), edge("3", "c", "a")])
    assert traverse.walk(g, "a", depth=0).count() == 0 == traverse.walk(g, "zzz").count()
    assert [(r.id, r.depth) for r in traverse.walk(g, "a", ["CALLS"]).collect()] == [("c", 2)], "the filter comes after the walk"
    assert traverse.walk(g, "a", ["CALLS"], typed_frontier=True).count() == 0
    r = traverse.walk_graph(g, "a", depth=3)
    assert {tuple(e) for e in r.edges.collect()} == {("a", "b", "CONTAINS", 1), ("b", "c", "CALLS", 2), ("c", "a", "CALLS", 3)}
    assert [x.id for x in traverse.trace(g, "b").orderBy("depth").collect()] == ["c", "a"]
    assert [x.id for x in traverse.blast_radius(g, "c").orderBy("depth").collect()] == ["b"]


def test_resolution(make):
    s = [symbol("1", "Repo", "base.base.Repo"), symbol("2", "Repo", "longer.base.base.Repo"), symbol("3", "X", "X"), symbol("4", "a.py", "/r/a.py", "FILE"), symbol("5", "dup", "m.dup"), symbol("6", "dup", "m.dup")]
    wanted = ["base.Repo", "Repo", "base.base.Repo", "X", "py", "none", "m.dup", "dup"]
    e = [edge(f"r{i}", "3", "", "IMPORTS", "unresolved", target_name=w) for i, w in enumerate(wanted)]
    e += [edge("call", "3", "", "CALLS", "unresolved", call_text="Repo", callee_name="Repo")]
    got = {r.id: (r.target_id, r.resolution) for r in resolve.resolve(make(s, e)).collect()}
    assert got == {
        "r0": ("1", "probable"), "r1": ("1", "probable"), "r2": ("1", "resolved"), "r3": ("3", "resolved"), "r4": ("4", "probable"),
        "r6": ("6", "resolved"), "r7": ("5", "probable"),
    }
    after = resolve.resolved_graph(make(s, e)).relationships
    assert after.count() == len(e) and after.filter("id = 'call'").first().target_id == ""


def test_ladder_against_definition(make):
    names = ["save", "Save", "saved", "a.save", "save_all", "SAVE", "x", "resave"]
    g = make([symbol(str(i), n, f"m.{n}" if i % 2 else n) for i, n in enumerate(names)])

    def score(name, full, q):
        low = q.lower()
        if full == q:
            return 1.0
        if name == q:
            return 0.95
        if "." in q:
            f = full.lower()
            return 1.0 if f == low else 0.9 if f.endswith("." + low) else 0.75 if low in f else None
        n = name.lower()
        return 0.85 if n == low else 0.8 if full.lower().endswith("." + low) and low in n else 0.6 if low in n else None

    for q in ("save", "a.save", "M.SAVE", "sav"):
        got = {r.id: r.score for r in search.find_symbol(g, q, fuzzy=False).collect()}
        want = {str(i): score(n, f"m.{n}" if i % 2 else n, q) for i, n in enumerate(names)}
        assert got == {k: v for k, v in want.items() if v is not None}
