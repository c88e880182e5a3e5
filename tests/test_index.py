import json

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.functions import render
from loomgraph.operators import ingest, lookup, search, stats, traverse
from loomgraph.operators.graph import Graph, GraphStore, find_store
from loomgraph.sources.tree import list_tree, source_files

FILES = {
    "services.py": '''LIMIT = 3


class AccountService:
    """Manages accounts."""

    def __init__(self, store):
        self.store = store

    def create_account(self, name):
        row = self.store.save(name)
        self._notify(name)
        return row

    def _notify(self, name):
        send_mail(name)


class AccountStore:
    def save(self, row):
        return row


def send_mail(to):
    return True


def bootstrap():
    store = AccountStore()
    return AccountService(store)
''',
    "base.py": "from abc import ABC, abstractmethod\n\n\nclass Store(ABC):\n    @abstractmethod\n    def save(self, row): ...\n",
    "impl.py": "from base import Store\nfrom pkg.core import TIMEOUT\n\n\nclass SqlStore(Store):\n    def save(self, row):\n        return row\n",
    "pkg/__init__.py": "",
    "pkg/core.py": "TIMEOUT = 5\r\n\r\n\r\ndef run():\r\n    return TIMEOUT\r\n",
    "pkg/_private.pyi": "def hidden() -> None: ...\n",
    "broken.py": "def (:\n",
    "build/skipped.py": "x = 1\n",
    "x.egg-info/skipped.py": "x = 1\n",
    "notes.txt": "not code",
    ".dot/UPPER.PY": "y = 1\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (root / "latin.py").write_bytes(b"# caf\xe9\n")
    return root


@pytest.fixture(scope="module")
def indexed(spark, tree):
    store = GraphStore(spark, (tree / ".loomgraph").as_uri())
    seen = []
    result = ingest.index(store, str(tree), progress=lambda p, k, n: seen.append((k, n)))
    return store, result, seen


@pytest.fixture(scope="module")
def graph(indexed):
    g = indexed[0].graph()
    return Graph(g.files.cache(), g.symbols.cache(), g.relationships.cache())


def test_discovery(spark, tree):
    found = [p[len(str(tree)) + 1 :] for p in list_tree(str(tree))]
    assert found == ["base.py", "broken.py", "impl.py", "latin.py", "services.py", ".dot/UPPER.PY", "pkg/__init__.py", "pkg/_private.pyi", "pkg/core.py"]
    rows = {r.path[len(str(tree)) + 1 :]: r for r in source_files(spark, str(tree), files_a_task="2").collect()}
    assert set(rows) == set(found) - {"latin.py"}
    assert rows["pkg/core.py"].module == "pkg.core" and rows["pkg/_private.pyi"].module == "pkg._private.pyi" and rows["pkg/__init__.py"].module == "pkg.__init__"
    assert "\r" not in rows["pkg/core.py"].text and rows["pkg/core.py"].size_bytes == len(FILES["pkg/core.py"])
    assert source_files(spark, str(tree / "base.py")).count() == 1
    assert source_files(spark, str(tree / "notes.txt")).count() == 0


def test_index(indexed, graph):
    _, result, seen = indexed
    assert (result.files_discovered, result.files_analyzed, len(result.errors)) == (8, 7, 1)
    assert result.symbols_extracted == graph.symbols.count() and result.relationships_extracted == graph.relationships.count()
    assert seen == [(k, 8) for k in range(1, 9)]
    got = {(r.metadata["target_name"], r.resolution) for r in graph.relationships.filter("metadata['target_name'] IS NOT NULL").collect()}
    assert got == {
        ("abc.ABC", "unresolved"), ("abc.abstractmethod", "unresolved"), ("base.Store", "probable"), ("pkg.core.TIMEOUT", "resolved"), ("Store", "probable"),
    }
    assert result.relationships_resolved == 3
    assert graph.relationships.filter("type = 'CALLS' AND resolution = 'unresolved'").count() > 0


def only(graph, query):
    return search.find_symbol(graph, query).first()


def test_search(graph):
    assert only(graph, "AccountService").score == 0.95
    best = only(graph, "AccountService.create_account")
    assert (best.name, best.score, best.step) == ("create_account", 0.90, 3)
    assert only(graph, "creat_account").name == "create_account" and only(graph, "AccountServce.create_account").name == "create_account"
    assert search.find_symbol(graph, "__nothing_like_it__").count() == 0 == search.find_symbol(graph, "  ").count()
    assert {r.name for r in search.find_symbol(graph, "create").collect()} >= {"create_account"}
    assert search.find_symbol(graph, "a", limit=2).count() == 2
    assert {r.name for r in lookup.find_by_name(graph, "S_ve").collect()} == {"save"}, "an underscore is a wildcard"
    assert lookup.find_by_name(graph, "\\").count() == 0


def test_resolve_symbol(graph):
    assert search.resolve_symbol(graph, "nothing like it at all") is None
    one = search.resolve_symbol(graph, "AccountService.create_account")
    assert graph.symbols.filter(F.col("id") == one).first().name == "create_account"
    asked = []
    pick = lambda rows: asked.append(rows) or "2"
    two = search.resolve_symbol(graph, "save", pick)
    assert two == asked[0][1].id and search.resolve_symbol(graph, "save", lambda rows: "x") is None
    assert search.resolve_symbol(graph, "save", lambda rows: "99") is None


def test_one_hop(graph):
    ids = {r.qualified_name: r.id for r in graph.symbols.collect()}
    full = "services.services."
    assert [(r.name, r.rel_resolution) for r in lookup.callers(graph, ids[full + "AccountStore"]).collect()] == [("bootstrap", "probable")]
    assert {r.name for r in lookup.callees(graph, ids[full + "bootstrap"]).collect()} == {"AccountStore", "AccountService"}
    assert [r.name for r in lookup.implementations(graph, ids["base.base.Store"]).collect()] == ["SqlStore"]
    assert {r.name for r in lookup.importers(graph, ids["base.base.Store"]).collect()} == {"impl.py"}
    impl = next(i for q, i in ids.items() if q.endswith("impl.py"))
    assert {r.target for r in lookup.imports(graph, impl).collect()} == {"base.Store", "pkg.core.TIMEOUT"}
    assert {r.name for r in lookup.children(graph, ids[full + "AccountStore"]).collect()} == {"save"}
    assert [r.name for r in lookup.parents(graph, ids[full + "AccountStore.save"]).collect()] == ["AccountStore"]
    assert lookup.references(graph, ids[full + "AccountStore"]).count() == 0


def test_source(graph):
    i = search.resolve_symbol(graph, "AccountService._notify")
    s = ingest.get_source(graph, i)
    assert s.lines == ["    def _notify(self, name):", "        send_mail(name)"] and (s.start_line, s.end_line) == (15, 16)
    assert ingest.get_source(graph, "no") is None


def test_source_slices(spark, tree, graph):
    texts = source_files(spark, str(tree))
    got = {r.id: r.lines for r in ingest.source_slices(graph.symbols, texts).collect()}
    for r in graph.symbols.filter("kind <> 'FILE'").collect():
        assert got[r.id] == ingest.get_source(graph, r.id).lines


def test_renderings(graph):
    i = search.resolve_symbol(graph, "bootstrap")
    d = render.Drawing(graph, traverse.trace_graph(graph, i, 3))
    assert render.ascii_tree(d) == (
        "services.services.bootstrap [FUNCTION]\n|-- --[CALLS]--> services.services.AccountService [CLASS]\n"
        "\\-- --[CALLS]--> services.services.AccountStore [CLASS]"
    ) or render.ascii_tree(d).count("--[CALLS]-->") == 2
    dot = render.dot(d)
    assert dot.startswith("digraph CodeGraph {\n  rankdir=\"LR\";") and dot.endswith("}") and 'color="#1976D2", style="solid"' in dot and "penwidth=2.0" in dot
    m = render.mermaid(d)
    assert m.startswith("graph LR\n") and ":::rootClass" in m and " -- CALLS --> " in m and m.endswith("stroke-width:2px,color:#fff")
    mail = search.resolve_symbol(graph, "send_mail")
    assert render.ascii_tree(render.Drawing(graph, traverse.blast_radius_graph(graph, mail, 1))).endswith("(no relationships found)")
    assert traverse.walk_graph(graph, "no") is None


def test_export(graph, tmp_path):
    doc = json.loads(render.export_json(graph))
    assert set(doc) == {"files", "symbols", "relationships"} and len(doc["symbols"]) == graph.symbols.count()
    assert "indexed_at" not in doc["files"][0] and {"source_location", "metadata"} <= set(doc["relationships"][0])
    render.export_tables(graph, str(tmp_path / "out"))
    assert (tmp_path / "out" / "symbols").exists()


def test_stats(graph):
    got = stats.stats_dict(graph)
    assert list(got)[:4] == list(stats.TOTALS) and got["files"] == 8 and got["symbols_interface"] == 1 and got["rel_extends"] == 1
    assert got["unresolved_relationships"] == graph.relationships.filter("target_id = ''").count()


def test_incremental(spark, tree, tmp_path):
    import shutil

    root = tmp_path / "copy"
    shutil.copytree(tree, root, ignore=shutil.ignore_patterns(".loomgraph"))
    store = GraphStore(spark, (tmp_path / "store").as_uri())
    ingest.index(store, str(root))
    before = store.graph().symbols.count()
    assert ingest.index(store, str(root), incremental=True).files_discovered == 8
    assert store.graph().symbols.count() == before
    (root / "base.py").write_text("def only(): pass\n")
    result = ingest.index(store, str(root), incremental=True)
    assert result.files_analyzed == 1 and store.graph().symbols.count() == before - 3 + 2
    assert ingest.index(store, str(root), clear=False).files_analyzed == 7


def tables(store):
    g = store.graph()
    symbols = {(r.id, r.qualified_name, r.file_id, r.start_line, r.parent_id) for r in g.symbols.collect()}
    edges = {(r.id, r.source_id, r.target_id, r.type, r.resolution) for r in g.relationships.collect()}
    return {(r.id, r.path, r.content_hash) for r in g.files.collect()}, symbols, edges


def test_incremental_equals_a_full_index(spark, tmp_path):
    """After edits, moves and deletions the graph is that of indexing everything anew, edges into changed files included."""
    root = tmp_path / "src"
    root.mkdir()
    write = lambda name, text: (root / name).write_text(text)
    write("b.py", "class B:\n    def go(self): pass\n")
    write("a.py", "from b import B\nfrom b.b import B\n\nclass A(B):\n    pass\n\ndef run():\n    return A()\n")
    write("c.py", "from a import run\nclass C(A): pass\n")
    write("z.py", "class Deep:\n    class B: pass\n")
    store, full = (GraphStore(spark, (tmp_path / x).as_uri()) for x in ("store", "full"))
    ingest.index(store, str(root))

    def same():
        result = ingest.index(store, str(root), incremental=True)
        ingest.index(full, str(root))
        assert tables(store) == tables(full)
        return result.files_analyzed

    write("b.py", "\n\nLIMIT = 1\n\nclass B:\n    def go(self): pass\n")  # the class moves down: its id stays
    assert same() == 1
    names = {r.id: r.qualified_name for r in store.graph().symbols.collect()}
    assert {(names[r.source_id], names[r.target_id]) for r in store.graph().relationships.filter("type = 'EXTENDS'").collect()} == {("a.a.A", "b.b.B"), ("c.c.C", "a.a.A")}
    (root / "c.py").unlink()
    (root / "b.py").rename(root / "bb.py")
    assert same() == 1
    write("b.py", "class B: pass\n")
    write("x.py", "B = 1\n")
    assert same() == 2
    (root / "z.py").unlink()
    assert same() == 0


def test_commands(spark, indexed, tree, tmp_path, capsys):
    run = lambda *a: cli.run(spark, ["--store", str(tree / "pkg"), *a])
    assert find_store(tree / "pkg") == tree / ".loomgraph"
    assert "create_account" in run("find", "create_account") and "(fuzzy)" in run("find", "creat_account")
    assert "Manages accounts." in run("definition", "services.AccountService")
    assert "bootstrap" in run("callers", "services.AccountStore") and "AccountStore" in run("callees", "bootstrap")
    assert "SqlStore" in run("implementations", "base.Store") and run("refs", "bootstrap") == "No symbols found."
    assert "pkg.core.TIMEOUT" in run("imports", "impl.py") and "Via" in run("trace", "bootstrap")
    assert "No results." == run("blast-radius", "bootstrap") and "[FUNCTION]" in run("graph", "bootstrap")
    out = tmp_path / "g.dot"
    assert "Saved" in run("graph", "bootstrap", "-f", "dot", "-o", str(out), "--direction", "both") and out.read_text().startswith("digraph")
    assert "send_mail(name)" in run("source", "AccountService._notify")
    assert "Unresolved Relationships" in run("stats") and json.loads(run("export"))["files"] and "index" in run("help")
    with pytest.raises(SystemExit):
        run("callers", "__nothing_like_it__")
    with pytest.raises(SystemExit):
        cli.run(spark, ["--store", str(tmp_path), "stats"])
