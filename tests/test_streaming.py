from loomgraph.operators.graph import GraphStore
from loomgraph.streaming.watch import index_stream

SCHEMA = "path string, module string, text string"


def test_stream_of_changes(spark, tmp_path):
    store = GraphStore(spark, (tmp_path / "graph").as_uri())
    drop, checkpoint = str(tmp_path / "drop"), str(tmp_path / "checkpoint")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(drop)
        index_stream(store, spark.readStream.schema(SCHEMA).parquet(drop), checkpoint).awaitTermination()
        g = store.graph()
        names = {r.id: r.qualified_name for r in g.symbols.collect()}
        extends = [(names[r.source_id], names.get(r.target_id), r.resolution) for r in g.relationships.filter("type = 'EXTENDS'").collect()]
        return sorted(names.values()), extends

    got = run([("/r/a.py", "a", "class A(B): pass\n"), (None, "x", "y = 1"), ("/r/n.py", "n", None)])
    assert got == (["/r/a.py", "a.a.A"], [("a.a.A", None, "unresolved")])
    got = run([("/r/b.py", "b", "class B: pass\n")])
    assert got == (["/r/a.py", "/r/b.py", "a.a.A", "b.b.B"], [("a.a.A", "b.b.B", "probable")])
    got = run([("/r/a.py", "a", "class C(B): pass\n")])
    assert got == (["/r/a.py", "/r/b.py", "a.a.C", "b.b.B"], [("a.a.C", "b.b.B", "probable")])
