"""The view model of a trimmed graph, and its HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, degrees, top_nodes
from .tidy import keep_nodes
from .traverse import subgraph

#: Colours by tier and by edge class: fixed values.
NODE_COLOURS = {"hub": "#E8593C", "major": "#7F77DD", "normal": "#378ADD", "minor": "#888780"}
EDGE_COLOURS = {"llm_strong": "#1D9E75", "llm_weak": "#5DCAA5", "cooc": "#555555"}


def trim(g: Graph, k: int = 50) -> Graph:
    """The subgraph that the k nodes of highest degree induce."""
    return keep_nodes(g, top_nodes(g, k))


def view_nodes(g: Graph, low: int = 10, high: int = 60) -> DataFrame:
    """(node, degree, size, tier, colour) of a trimmed graph: sizes by min-max of degree, tiers by rank fraction.

    The windows run over a trimmed graph, top_k nodes at most.
    """
    every = Window.partitionBy(F.lit(0))
    rows = degrees(g).join(g.nodes.select("node", "node_ord"), "node")
    lo, hi = F.min("degree").over(every), F.max("degree").over(every)
    share = (F.row_number().over(every.orderBy(F.desc("degree"), "node_ord")) - 1) / F.count("*").over(every)
    span = F.when(hi > lo, hi - lo).otherwise(1)
    rows = rows.withColumns({"size": (low + (F.col("degree") - lo) / span * (high - low)).cast("int"), "_p": share})
    rows = rows.withColumn("tier", F.when(F.col("_p") <= 0.10, "hub").when(F.col("_p") <= 0.25, "major").when(F.col("_p") <= 0.60, "normal").otherwise("minor"))
    colour = F.element_at(F.create_map(*[F.lit(x) for kv in NODE_COLOURS.items() for x in kv]), F.col("tier"))
    return rows.select("node", "degree", "size", "tier", colour.alias("colour"))


def view_edges(g: Graph, low: float = 0.5, high: float = 8.0) -> DataFrame:
    """(src, dst, width, kind, colour, text): widths by min-max of weight (2 places); only extracted edges have a text."""
    span = F.broadcast(g.edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")))  # one row
    width = F.round(low + (F.col("weight") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * (high - low), 2)
    kind = F.when(~F.col("is_llm_edge"), "cooc").when(F.col("predicate_strength") == "strong", "llm_strong").otherwise("llm_weak")
    rows = g.edges.crossJoin(span).withColumns({"width": width, "kind": kind})
    colour = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_COLOURS.items() for x in kv]), F.col("kind"))
    return rows.select("src", "dst", "width", "kind", colour.alias("colour"), F.when(F.col("is_llm_edge"), F.col("label")).otherwise("").alias("text"))


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title><style>
body {{ margin: 0; background: #16181d; color: #ddd; font: 13px sans-serif }} svg {{ width: 100vw; height: 100vh }}
.faded {{ opacity: .08 }} #info {{ position: fixed; top: 8px; left: 12px }}
</style></head><body><div id="info">{title}: {n} concepts, {m} relations. {legend}
<input id="find" placeholder="filter"></div><svg viewBox="-600 -600 1200 1200"></svg><script>
const nodes = {nodes}, edges = {edges}, ns = "http://www.w3.org/2000/svg", svg = document.querySelector("svg");
const place = Object.fromEntries(nodes.map((x, i) => [x.id, [520 * Math.cos(6.2832 * i / nodes.length), 520 * Math.sin(6.2832 * i / nodes.length)]]));
function add(kind, attrs, tip) {{ const x = document.createElementNS(ns, kind); for (const k in attrs) x.setAttribute(k, attrs[k]);
  const t = document.createElementNS(ns, "title"); t.textContent = tip; x.append(t); svg.append(x); return x; }}
for (const e of edges) e.el = add("line", {{x1: place[e.from][0], y1: place[e.from][1], x2: place[e.to][0], y2: place[e.to][1], stroke: e.colour, "stroke-width": e.width}}, e.tip);
for (const x of nodes) {{ x.el = add("circle", {{cx: place[x.id][0], cy: place[x.id][1], r: x.size / 3, fill: x.colour}}, x.tip);
  const t = add("text", {{x: place[x.id][0], y: place[x.id][1] - 8, fill: "#ddd", "font-size": 11, "text-anchor": "middle"}}, x.tip); t.append(x.id); x.el.onclick = () => focus(x.id); }}
function near(ids) {{ const out = new Set(ids); for (const e of edges) {{ if (ids.has(e.from)) out.add(e.to); if (ids.has(e.to)) out.add(e.from); }} return out; }}
function show(ids) {{ for (const x of nodes) x.el.classList.toggle("faded", !ids.has(x.id)); for (const e of edges) e.el.classList.toggle("faded", !(ids.has(e.from) && ids.has(e.to))); }}
function focus(id) {{ show(near(near(new Set([id])))); }}
document.querySelector("#find").oninput = e => show(new Set(nodes.filter(x => x.id.includes(e.target.value.toLowerCase())).map(x => x.id)));
</script></body></html>
"""


def render(g: Graph, path: str, title: str = "Concept graph", top_k: int = 50) -> str:
    """Writes the trimmed graph as a page; an empty graph writes nothing. Labels are escaped. Returns the path."""
    small = trim(g, top_k).settled()
    shown = view_nodes(small).join(small.nodes.select("node", "frequency", "weight", "doc_sources"), "node").orderBy(F.desc("degree"), "node").collect()
    if not shown:
        return path
    links = view_edges(small).join(small.edges.select("src", "dst", "label", "predicates", "weight"), ["src", "dst"]).orderBy("src", "dst").collect()
    nodes = [{"id": r.node, "size": r.size, "colour": r.colour, "tip": f"{r.node}\ndegree {r.degree}, frequency {r.frequency}, weight {r.weight}\n{', '.join(r.doc_sources)}"} for r in shown]
    edges = [{"from": r.src, "to": r.dst, "width": r.width, "colour": r.colour, "tip": f"{r.label}\n{', '.join(r.predicates)}\nweight {r.weight}, {r.kind}"} for r in links]
    safe = lambda x: json.dumps(x).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    legend = " ".join(f'<span style="color:{c}">{html.escape(t)}</span>' for t, c in {**NODE_COLOURS, **EDGE_COLOURS}.items())
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=html.escape(title), n=len(nodes), m=len(edges), legend=legend, nodes=safe(nodes), edges=safe(edges)))
    return path


def render_subgraph(g: Graph, node: str, path: str, depth: int = 2, top_k: int = 50) -> str:
    """Renders the neighbourhood of the exact node, else of the first that holds the text; none writes nothing."""
    hit = g.nodes.where(F.col("node") == node).select("node").first() or g.nodes.where(F.col("node").contains(node)).orderBy("node_ord").select("node").first()
    return render(subgraph(g, hit.node, depth), path, hit.node, top_k) if hit else path
