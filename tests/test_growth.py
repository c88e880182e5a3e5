"""What has to stay bounded as tables grow."""

import os

from loomgraph.plans import generated
from loomgraph.sources import tree


def test_generated_files_are_spread_over_tasks(spark):
    files = generated.generated_files(spark, "/root/testdata/sf0.1")
    assert files.rdd.getNumPartitions() >= 15_000 // generated.FILES_A_PART


def test_what_is_once_in_a_folder_is_written_once(tmp_path, monkeypatch):
    import pandas as pd

    opened = []
    monkeypatch.setattr("builtins.open", lambda name, *how, real=open: opened.append(str(name)) or real(name, *how))
    batches = [pd.DataFrame({"path": [f"/gen/{n}/c{k}.py" for n in "ab"], "text": ["x = 1\n"] * 2}) for k in range(20)]
    assert sum(r["n"].sum() for r in generated._write_rows(str(tmp_path))(iter(batches))) == 40
    assert len([x for x in opened if x.endswith("__init__.py")]) == 2 and len(set(opened)) == len(opened) == 3 * 40 + 2 * 2
    assert len(tree.list_tree(str(tmp_path))) == 2 * 40 + 2


def test_large_trees_take_larger_tasks_and_packed_names(tmp_path, monkeypatch):
    for k in range(3_000):
        folder = tmp_path / f"d{k % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"module_{k:06}.py").touch()
    names = tree.list_tree(str(tmp_path))
    parts = tree._Reader(str(tmp_path), ("python",), None).partitions()
    assert len(parts) == 15 and sum(len(n) for p in parts for _, n in p.parts) < sum(map(len, names)) / 3
    monkeypatch.setattr(tree, "MANY_TASKS", 4)
    for size in (None, 7, 450):
        parts = tree._Reader(str(tmp_path), ("python",), size).partitions()
        assert [x for p in parts for x in p.paths()] == names
        got = [(k, path) for p in parts for b in tree._Reader(str(tmp_path), ("python",), size).read(p) for k, path in zip(b["ordinal"].to_pylist(), b["path"].to_pylist())]
        assert got == list(enumerate(names))
        assert size or len(parts) <= 5
        assert not size or all(len(list(p.paths())) <= size for p in parts)


def test_module_names_look_at_a_folder_once(tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for place in ("a/__init__.py", "a/b/__init__.py"):
        (tmp_path / place).touch()
    known = {}
    assert [tree.module_name(str(tmp_path / "a" / "b" / f), known) for f in ("x.py", "y.pyi")] == ["a.b.x", "a.b.y.pyi"]
    monkeypatch.setattr(os, "stat", None)
    assert tree.module_name(str(tmp_path / "a" / "b" / "z.py"), known) == "a.b.z"


def test_analysis_hands_on_few_files_at_once(spark):
    """Before, all files of a batch of 10,000 were held as rows of a table of nested Python objects."""
    from pyspark.sql import functions as F

    from loomgraph.operators import ingest

    files = generated.generated_files(spark, "/root/testdata/sf0.01").limit(600).coalesce(1)

    class Counting(ingest.PythonAnalyzer):
        def analyze(self, *file):
            if file[1].endswith("7.py"):
                raise ValueError("seven")
            return super().analyze(*file)

    plan = ingest.analyze(files, (Counting(),))
    assert "MapInArrow" in plan._jdf.queryExecution().toString()
    rows = plan.select("error", F.size("symbols").alias("s"), F.size("relationships").alias("r")).collect()
    assert len(rows) == 600 and {(x.s, x.r) for x in rows} == {(7, 12), (0, 0)}
    assert all((x.error or "").endswith(": seven") == (x.s == 0) for x in rows) and 0 < sum(x.s == 0 for x in rows) < 600


def test_a_slice_is_made_of_one_analysis(spark):
    from loomgraph.plans import catalogue

    plan = catalogue.QUERIES["source_slice"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


def test_the_recursive_walk_has_no_limit_of_rows(spark):
    from loomgraph.operators import traverse
    from loomgraph.operators.graph import Graph
    from loomgraph.plans.schema import RELATIONSHIPS, SYMBOLS

    edges = [("a", f"m{k}") for k in range(30)] + [(f"m{k}", f"z{j}") for k in range(30) for j in range(30)] + [("z0", "end")]
    names = sorted({x for e in edges for x in e})
    symbols = spark.createDataFrame([(n, n, n, "CLASS", "python", "f", 1, 2, "", None, "", False) for n in names], SYMBOLS)
    rels = spark.createDataFrame([(f"{s}-{t}", s, t, "CALLS", None, "resolved", {}) for s, t in edges], RELATIONSHIPS)
    g = Graph(spark.createDataFrame([], "id string"), symbols, rels)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {(r.id, r.depth) for r in traverse.walk(g, "a", engine="cte").collect()}
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "20"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(n, {"m": 1, "z": 2, "e": 3}[n[0]]) for n in names if n != "a"}


def test_the_copy_by_target_is_made_when_asked_for_and_without_lost_edges(spark, tmp_path):
    """Lost edges share the target '': as part of the copy, all of them came into one task."""
    from loomgraph.operators import traverse
    from loomgraph.plans.derived import stored_graph
    from loomgraph.storage import shared_folder

    place = tmp_path / "sf"
    place.symlink_to("/root/testdata/sf0.001")
    home = os.path.join(shared_folder(spark).removeprefix("file://"), f"graph-{spark.sparkContext.applicationId}")
    made = lambda: sorted(x for x in os.listdir(home) if x.startswith("incoming-")) if os.path.exists(home) else []
    before = made()
    g = stored_graph(spark, str(place))
    assert traverse.walk(g, "nation:3").count() > 0 and made() == before
    assert traverse.walk(g, "part:7", direction="in").count() > 0 and traverse.walk(g, "part:7", direction="both").count() > 0
    assert len(made()) == len(before) + 1
    lost = g.relationships.filter("target_id = ''").count()
    assert lost > 0 == g.incoming().filter("target_id = ''").count() and g.incoming().count() + lost == g.relationships.count()
