import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    answer = tables.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda rows, names: sorted(str([row[names.index(c)] for c in sorted(names)]) for row in rows)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(answer.fetchall(), columns)


def test_likeness_against_brute_force(spark):
    """SQL has no such ratio, so every symbol is scored here by the standard library."""
    from difflib import SequenceMatcher

    from loomgraph.plans.derived import stored_graph

    text = "suplier#00000005"
    every = [(r.id, r.name, r.qualified_name) for r in stored_graph(spark, SF).symbols.collect()]
    raw = {i: SequenceMatcher(None, text, n.lower()).ratio() for i, n, _ in every}
    score = lambda r: round(0.70 + (r - 0.80) * 0.45 if r >= 0.80 else 0.45 + (r - 0.60) * 0.70, 3)
    want = sorted(((-score(raw[i]), 7 if raw[i] >= 0.80 else 8, -raw[i], q, i) for i, _, q in every if raw[i] >= 0.60))[:20]
    got = catalogue.QUERIES["find_fuzzy"](spark, SF).collect()
    assert [(-r.score, r.step, -r.raw, r.qualified_name, r.id) for r in got] == want and len(got) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the corpus folders and the pipeline, everything else imports."""
    for part in ("loomgraph", "__spark_entry__.py"):
        src = os.path.join(ROOT, part)
        shutil.copytree(src, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path / part)
    code = "import __spark_entry__ as e; assert 'blast_radius' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
