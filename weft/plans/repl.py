"""The command line: python -m weft.plans.repl TRIPLETS.csv, or FOLDER [SAVED] to build once and load what is saved."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import query, traverse, view
from ..operators.graph import Graph
from ..sources import files
from .pipeline import triplets_of, weighted_graph

HELP = """neighbours NODE (n) | path A, B (p) | hubs (h) | search WORD (s) | summary (stats)
ask QUESTION (a) | subgraph NODE (sub) | help (?) | quit (q)"""


def answer(g: Graph, line: str, out_dir: str = ".", client: Callable[[list[dict]], str] | None = None) -> str | None:
    """The text that a command line gives; None to end."""
    command, _, rest = line.strip().partition(" ")
    command, rest = command.lower(), rest.strip()
    first = lambda q: next(iter(query.find_node(g, q)), None)
    if command in ("quit", "exit", "q"):
        return None
    if command in ("neighbours", "neighbors", "n"):
        if (node := first(rest)) is None:
            return f"no concept like {rest!r}"
        rows = query.neighbours(g, node).orderBy("direction", "weight", ascending=[False, False]).collect()
        return "\n".join([node, *(f"  {'->' if r.direction == 'out' else '<-'} {r.other} [{r.label}] {'#' * max(1, int(r.weight * 10))} {r.weight}" for r in rows)])
    if command in ("path", "p"):
        a, b = (first(x) if x.strip() else None for x in (rest.partition(",")[0], rest.partition(",")[2]))
        if a is None or b is None:
            return "give two known concepts: path A, B"
        if a == b:
            return f"{a}: 0 hops"
        rows = traverse.shortest_path(g, a, b).orderBy("step").collect()
        return "\n".join([f"{len(rows)} hops", *(f"  {r.src} --[{r.label}]--> {r.dst}" for r in rows)]) if rows else f"no path between {a} and {b}"
    if command in ("hubs", "h"):
        return "\n".join(f"{r.node}: degree {r.degree} (in {r.in_degree}, out {r.out_degree}), frequency {r.frequency}, weight {r.weight}" for r in query.hubs(g).collect())
    if command in ("search", "s"):
        return "\n".join(r.node for r in query.search(g, rest).orderBy("node_ord").collect()) or "nothing found"
    if command in ("summary", "stats"):
        s = query.graph_summary(g).first()
        return f"{s.nodes} concepts, {s.edges} relations, density {s.density}\ntop: {s.top_concepts}\nrelations: {', '.join(s.relation_types[:6])}"
    if command in ("ask", "a"):
        return client(query.ask_messages(g, rest)) if client else query.build_context(g, rest)
    if command in ("subgraph", "sub"):
        name = re.sub(r"[^a-z0-9]+", "-", rest.lower()).strip("-") or "graph"
        return view.render_subgraph(g, first(rest) or rest, os.path.join(out_dir, f"subgraph-{name}.html"))
    return HELP if command in ("help", "?", "") else f"unknown command {command!r}\n{HELP}"


def _saved(spark: SparkSession, path: str) -> DataFrame:
    found = files.read_triplets(spark, path)
    found.limit(1).count()  # a missing path shows only here
    return found


def triplets_at(spark: SparkSession, path: str, saved: str | None = None) -> DataFrame:
    """Triplets of a CSV, or those saved from a folder of documents; if none are saved yet, they are made and saved."""
    if path.endswith(".csv"):
        return files.read_triplets(spark, path)
    if saved is None:
        return triplets_of(files.load_documents(spark, path))
    try:
        return _saved(spark, saved)
    except AnalysisException:
        files.write_triplets(triplets_of(files.load_documents(spark, path)), saved)
        return _saved(spark, saved)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("weft").getOrCreate()
    g = weighted_graph(triplets_at(spark, args[0], next((x for x in args[1:] if not x.startswith("--")), None)), clean="--clean" in args)
    while True:
        try:
            text = answer(g, input("> "))
        except (EOFError, KeyboardInterrupt):
            return
        if text is None:
            return
        print(text)


if __name__ == "__main__":
    main(sys.argv[1:])
