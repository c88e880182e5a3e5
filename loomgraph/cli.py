"""``python -m loomgraph.cli``: index a source tree and ask its graph."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.functions import render
from loomgraph.operators import ingest, lookup, search, stats, traverse
from loomgraph.operators.graph import Graph, GraphStore, find_store

FOLDER = ".loomgraph"

CHEAT_SHEET = """\
index [PATH]             build the graph of a source tree
find QUERY               search symbols by name, dotted suffix or likeness
definition SYMBOL        where a symbol is defined
callers | callees        one hop along calls
refs | implementations   what refers to a symbol, or implements it
imports SYMBOL           what a file imports
trace | blast-radius     several hops out, or in
graph SYMBOL             a walk along all relationships
source SYMBOL            its lines
stats | export           counts, or everything as JSON"""


def table(title: str, header: list[str], rows: list[list]) -> str:
    """Columns padded to their longest cell."""
    cells = [header, *([str(c) for c in r] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(header))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([title, lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def _ask(rows: list) -> str:
    for k, r in enumerate(rows, 1):
        print(f"{k:3}  {r.kind:10} {r.qualified_name}" + "  (fuzzy)" * (r.score < 0.80))
    return (input("Pick a number [1]: ") or "1") if sys.stdin.isatty() else "1"


def _score(score: float) -> str:
    return f"{score:.2f}" + " (fuzzy)" * (score < 0.80)


def symbol_table(graph: Graph, rows: list, title: str) -> str:
    """Kind, name, file and lines; scores only where one is below 0.90."""
    if not rows:
        return "No symbols found."
    paths = {r.id: r.path for r in graph.files.filter(F.col("id").isin(sorted({r.file_id for r in rows}))).select("id", "path").collect()}
    scored = any(r["score"] < 0.90 for r in rows if "score" in r)
    body = [[r.kind, r.qualified_name, Path(paths[r.file_id]).name if r.file_id in paths else "?", f"{r.start_line}-{r.end_line}", *([_score(r.score)] if scored else [])] for r in rows]
    return table(title, ["Kind", "Name", "File", "Lines", *["Score"] * scored], body)


def _call_table(rows: list, title: str, who: str) -> str:
    body = [[r.kind, r.qualified_name, r.rel_line or "—", r.rel_resolution] for r in sorted(rows, key=lambda r: (r.rel_line or 0, r.qualified_name, r.rel_id))]
    return table(title, ["Kind", who, "Line", "Confidence"], body)


def _walk_table(drawing: render.Drawing, title: str) -> str:
    if not drawing.nodes:
        return "No results."
    return table(title, ["Depth", "Via", "Kind", "Symbol"], [[n.depth, n.via or "—", n.kind, n.qualified_name] for n in drawing.nodes])


def show_walk(graph: Graph, result: traverse.TraceResult, fmt: str, title: str, output: str | None) -> str:
    """A walk as tree, DOT, Mermaid (to a file if one is named), or as a table for any other word."""
    drawing, fmt = render.Drawing(graph, result), fmt.lower().strip()
    makers: dict[str, Callable] = {"tree": render.ascii_tree, "dot": render.dot, "mermaid": render.mermaid}
    if fmt not in makers:
        return _walk_table(drawing, title)
    text = makers[fmt](drawing)
    if output:
        Path(output).write_text(text, encoding="utf-8")
        return f"Saved {fmt} to {output}"
    return text


class Commands:
    def __init__(self, spark, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def graph_of(self) -> Graph:
        found = find_store(Path(self.args.store or "."))
        if found is None:
            raise SystemExit(f"No {FOLDER} here or above; run 'index' first.")
        return GraphStore(self.spark, found.as_uri()).graph()

    def symbol(self) -> tuple[Graph, str]:
        graph = self.graph_of()
        found = search.resolve_symbol(graph, self.args.symbol, _ask)
        if found is None:
            raise SystemExit(f"No symbol found matching {self.args.symbol!r}")
        return graph, found

    def index(self) -> str:
        root = Path(self.args.path).resolve()
        store = GraphStore(self.spark, (root / FOLDER).as_uri())
        s = ingest.index(store, str(root), clear=self.args.clear, incremental=self.args.incremental, progress=lambda p, k, n: print(f"[{k}/{n}] {p}", end="\r", file=sys.stderr))
        out = [f"Files analyzed: {s.files_analyzed} / {s.files_discovered}", f"Symbols extracted: {s.symbols_extracted}", f"Relationships: {s.relationships_extracted}", f"Resolved cross-file: {s.relationships_resolved}"]
        return "\n".join([*out, *([f"Errors: {len(s.errors)}", *s.errors[:10]] if s.errors else [])])

    def find(self) -> str:
        graph = self.graph_of()
        return symbol_table(graph, search.find_symbol(graph, self.args.query, self.args.limit).collect(), f"Results for {self.args.query}")

    def definition(self) -> str:
        graph, i = self.symbol()
        r = lookup.with_files(graph, lookup.get_definition(graph, i)).first()
        out = [f"{r.qualified_name}", f"Kind: {r.kind}", f"Language: {r.language}", f"File: {r.file_path}", f"Lines: {r.start_line}-{r.end_line}"]
        out += [f"Signature: {r.signature}"] * bool(r.signature) + ["Async: yes"] * r.is_async + [r.docstring[:200]] * bool(r.docstring)
        return "\n".join(out)

    def callers(self) -> str:
        graph, i = self.symbol()
        rows = lookup.callers(graph, i).collect()
        return _call_table(rows, "Callers", "Caller") if rows else "No callers found."

    def callees(self) -> str:
        graph, i = self.symbol()
        rows = lookup.callees(graph, i).collect()
        return _call_table(rows, "Callees", "Callee") if rows else "No callees found."

    def refs(self) -> str:
        graph, i = self.symbol()
        return symbol_table(graph, lookup.references(graph, i).collect(), "References")

    def implementations(self) -> str:
        graph, i = self.symbol()
        return symbol_table(graph, lookup.implementations(graph, i).collect(), "Implementations")

    def imports(self) -> str:
        graph, i = self.symbol()
        rows = lookup.imports(graph, i).select("target", "resolution").orderBy("target").collect()
        return table("Imports", ["Target", "Status"], [list(r) for r in rows]) if rows else "No imports found."

    def _walk(self, walker: Callable, title: str) -> str:
        graph, i = self.symbol()
        result = walker(graph, i)
        if result is None or result.nodes.isEmpty():
            return "No results."
        return show_walk(graph, result, self.args.format, title, self.args.output)

    def trace(self) -> str:
        return self._walk(lambda g, i: traverse.trace_graph(g, i, self.args.depth), "Trace")

    def blast_radius(self) -> str:
        return self._walk(lambda g, i: traverse.blast_radius_graph(g, i, self.args.depth), "Blast radius")

    def graph(self) -> str:
        return self._walk(lambda g, i: traverse.walk_graph(g, i, None, self.args.direction, self.args.depth), "Graph")

    def source(self) -> str:
        graph, i = self.symbol()
        s = ingest.get_source(graph, i)
        if s is None:
            raise SystemExit("Could not retrieve source.")
        body = [f"{k:5}  {line}" for k, line in enumerate(s.lines, s.start_line)]
        return "\n".join([f"{Path(s.file_path).name}  :{s.start_line}-{s.end_line}", *body])

    def stats(self) -> str:
        got = stats.stats_dict(self.graph_of())
        name = lambda k: k.replace("_", " ").title() if k in stats.TOTALS else "  " + k.split("_", 1)[1].capitalize()
        return table("Graph statistics", ["Metric", "Count"], [[name(k), n] for k, n in got.items()])

    def export(self) -> str:
        text = render.export_json(self.graph_of())
        if self.args.output:
            Path(self.args.output).write_text(text, encoding="utf-8")
            return f"Exported to {self.args.output}"
        return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--store", help="a folder in or below the indexed tree (default: the current one)")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("path", nargs="?", default=".")
    a.add_argument("--clear", action=argparse.BooleanOptionalAction, default=True)
    a.add_argument("--incremental", action="store_true")
    a = sub.add_parser("find")
    a.add_argument("query")
    a.add_argument("-n", "--limit", type=int, default=20)
    for name in ("definition", "callers", "callees", "refs", "implementations", "imports", "source"):
        sub.add_parser(name).add_argument("symbol")
    for name, depth, fmt in (("trace", 5, "table"), ("blast-radius", 3, "table"), ("graph", 3, "tree")):
        a = sub.add_parser(name)
        a.add_argument("symbol")
        a.add_argument("-d", "--depth", type=int, default=depth)
        a.add_argument("-f", "--format", default=fmt)
        a.add_argument("-o", "--output")
        if name == "graph":
            a.add_argument("--direction", default="out")
    sub.add_parser("stats")
    a = sub.add_parser("export")
    a.add_argument("-o", "--output")
    a.add_argument("-f", "--format", default="json")
    sub.add_parser("help")
    return p


def run(spark, argv: list[str]) -> str:
    args = parser().parse_args(argv)
    if args.command == "help":
        return CHEAT_SHEET
    return getattr(Commands(spark, args), args.command.replace("-", "_"))()


def main() -> None:
    argv = sys.argv[1:]
    if argv[:1] == ["help"]:
        print(CHEAT_SHEET)
        return
    from loomgraph.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    print(run(spark, argv))


if __name__ == "__main__":
    main()
