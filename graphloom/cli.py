"""Command line: ``python -m graphloom.cli index|query|nav|analyze ...``; answers are JSON on standard output."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import SymbolGraph
from .operators import commits as K
from .operators import guide as G
from .operators import health as H
from .operators import impact as I
from .operators import lookup, metrics, order, rank, sets, traverse
from .operators.render import repo_map, report, to_json, to_rows
from .sources import gitlog, graphfile, rust
from .sources.snippets import snippets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("graphloom", description="Questions about code, answered from its graph.")
    top = p.add_subparsers(dest="group", required=True)
    i = top.add_parser("index")
    i.add_argument("project")
    i.add_argument("--all", action="store_true")
    i.add_argument("--no-tests", action="store_true")
    i.add_argument("--max-depth", type=int, default=4)
    i.add_argument("--output")
    i.add_argument("--profile", default="default")
    i.add_argument("--features", default="", help="names, parted by commas")
    i.add_argument("--all-features", action="store_true")
    i.add_argument("--no-default-features", action="store_true")
    i.add_argument("--target")
    i.add_argument("--mir", help="file or folder with the compiler's intermediate text")
    groups = {
        "query": "stats summary symbols inspect trace find scope impact risk path export",
        "nav": "guide quality health report map retrieve",
        "analyze": "deps fanout tests hotspots diff refactor-order",
    }
    for group, names in groups.items():
        sub = top.add_parser(group).add_subparsers(dest="command", required=True)
        for name in names.split():
            c = sub.add_parser(name)
            c.add_argument("names", nargs="*")
            c.add_argument("--graph", action="append", default=[])
            c.add_argument("--project", default=".")
            c.add_argument("--depth", type=int, default=6 if name == "path" else 2)
            c.add_argument("--limit", type=int, default={"trace": 100, "impact": 100, "risk": 100, "summary": 30, "health": 20, "fanout": 20, "guide": 20, "hotspots": 20, "retrieve": 10}.get(name, 50))
            c.add_argument("--kind", default={"scope": "file", "export": "json"}.get(name))
            c.add_argument("--direction", choices=["up", "down", "both"], default="both")
            c.add_argument("--candidates", type=int, default=80)
            c.add_argument("--budget", type=int, default=8000)
            c.add_argument("--base", help="a commit, or the file of another graph")
            c.add_argument("--output")
            c.add_argument("--no-source", action="store_true")
            for flag in ("dead", "no-docs", "test-only", "filter-first"):
                c.add_argument(f"--{flag}", action="store_true")
            for number in ("min-callers", "max-callers", "min-degree", "max-degree"):
                c.add_argument(f"--{number}", type=int)
            c.add_argument("--visibility")
    return p


def answer(spark: SparkSession, g: SymbolGraph, a: argparse.Namespace) -> str:
    name = " ".join(a.names)
    one = lambda: lookup.require_unique(g, a.names[0])["id"]
    by = lambda df, first, *rest: df.orderBy(F.desc(first), *rest).limit(a.limit)
    match a.command:
        case "stats":
            return to_json("stats", metrics.stats(g))
        case "summary":
            return to_json("summary", metrics.top_files(g, a.limit))
        case "symbols":
            conditions = {k: getattr(a, k) for k in ("visibility", "no_docs", "dead", "test_only", "min_callers", "max_callers", "min_degree", "max_degree")}
            return to_json("symbols", G.compact(lookup.symbols(g, name, a.kind, a.limit, a.filter_first, **conditions)))
        case "inspect":
            found = lookup.find_nodes(g, a.names[0])
            if found.limit(2).count() != 1:
                return to_json("ambiguous", G.compact(found))
            node = one()
            both = lookup.adjacent(g, node, "in", limit=100).withColumn("way", F.lit("in")).unionByName(lookup.adjacent(g, node, "out", limit=100).withColumn("way", F.lit("out")))
            text = None if a.no_source else snippets(g, g.nodes.where(F.col("id") == node), g.root or a.project).first()
            return to_json("symbol", both, id=node, **({"source": text.asDict()} if text else {}))
        case "trace":
            return to_json("trace", traverse.trace(g, one(), a.direction, a.depth, a.limit).orderBy("way", "depth", "rank"))
        case "find":
            return to_json("find", lookup.ranked_nodes(g, name, a.limit))
        case "scope":
            return to_json("scope", lookup.scope_file(g, a.names[0]) if a.kind == "file" else lookup.scope_module(g, a.names[0]))
        case "impact" | "risk":
            node = one()
            public = not g.nodes.where((F.col("id") == node) & (F.col("visibility") == "pub")).isEmpty()
            i = I.impact(g, node, a.depth, a.limit)
            r = i.risk.first().asDict()
            tests = [t.id.rsplit("::", 1)[-1] for t in traverse.test_impact(g, a.names[0]).collect()]
            sites = i.call_sites.collect()
            hints = I.hints(r["level"], r["files"], r["sites"], public, any(s.call_style == "method" for s in sites), r["dependencies"])
            return to_json(a.command, i.files if a.command == "impact" else i.risk, risk=r, hints=hints, commands=I.advice(r["level"], tests))
        case "path":
            return to_json("path", traverse.shortest_path(g, one(), lookup.require_unique(g, a.names[1])["id"], a.depth).orderBy("position"))
        case "export":
            lines = {"json": sets.json_lines, "dot": sets.dot_lines}.get(a.kind)
            body = [r.line for r in (lines(g).orderBy("part", "ord") if lines else sets.mermaid_lines(g).orderBy("ord")).select("line").toLocalIterator()]
            return "\n".join({"dot": ["digraph code {", "  rankdir=LR;", *body, "}"], "mermaid": ["graph LR", *body]}.get(a.kind, body))
        case "guide":
            x = G.guide(g, name, a.depth, a.limit)
            return to_json("guide", x.read.orderBy("position"), roots=x.roots)
        case "quality":
            return to_json("quality", metrics.quality(g))
        case "health":
            return to_json("health", H.health(g))
        case "report":
            text = report(g)
            if a.output:
                with open(a.output, "w") as f:
                    f.write(text)
            return text
        case "map":
            return repo_map(g, a.budget)
        case "retrieve":
            return to_json("retrieve", rank.retrieve(g, name, a.limit, a.candidates))
        case "deps":
            return to_json("deps", by(H.deps_matrix(g, text=name), "weight", "f", "t"))
        case "fanout":
            return to_json("fanout", H.fanout(g).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "file").limit(a.limit))
        case "tests":
            return to_json("tests", traverse.test_impact(g, name, limit=a.limit) if name else traverse.static_tests(g, limit=a.limit))
        case "hotspots":
            return to_json("hotspots", by(K.hotspots(g, gitlog.log(spark, a.project)), "risk", "file"))
        case "diff":
            return diff(spark, g, a)
        case "refactor-order":
            steps, cycles, missing = order.refactor_order(g, a.names, a.depth)
            return to_json("refactor_order", steps.orderBy("step"), cycles=cycles, unresolved=missing)
    raise ValueError(a.command)


def diff(spark: SparkSession, g: SymbolGraph, a: argparse.Namespace) -> str:
    """Edges that came and went since another graph, or since a commit, whose files are unpacked and indexed."""
    if a.base and os.path.exists(a.base):
        return to_json("diff", sets.diff(graphfile.load(spark, a.base), g, a.limit), base=a.base)
    base = a.base or "HEAD"
    top = gitlog.top_folder(a.project)
    changed = gitlog.changed_files(spark, top, base)
    before = gitlog.checkout(spark, top, base)
    try:
        inside = os.path.join(before, os.path.relpath(os.path.realpath(a.project), os.path.realpath(top)))
        # the project's own name holds the folder it lies in
        own = lambda x: SymbolGraph(x.nodes, x.edges.where(~F.col("src").startswith("project:")))
        edges = to_rows(sets.diff(own(rust.index(spark, inside, False, f"base-{base}")), own(g), a.limit))
    finally:
        shutil.rmtree(before, ignore_errors=True)
    targets = [(t["name"], t["src_path"]) for p in g.packages for t in p["targets"]]
    hit = K.changed_targets(spark.createDataFrame(targets, "name string, src_path string"), changed)
    return to_json("diff", changed.orderBy("file"), base=base, edges=edges, health=to_rows(H.health(g))[0], changed_targets=to_rows(hit.orderBy("name", "src_path")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if a.group == "index":
        failed = 0
        for folder in rust.find_projects(a.project, a.max_depth) if a.all else [a.project]:
            try:
                graphfile.save(rust.index(spark, folder, not a.no_tests, a.profile, [f for f in a.features.split(",") if f], a.all_features, a.no_default_features, a.target, a.mir), a.output or graphfile.default_path(folder))
            except Exception as e:  # one project that fails does not stop the others
                failed += 1
                print(f"{folder}: {e}", file=sys.stderr)
        return int(failed > 0)
    try:
        print(answer(spark, graphfile.load_many(spark, a.graph, os.path.abspath(a.project)), a))
    except (LookupError, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
