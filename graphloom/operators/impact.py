"""What a change of a symbol touches, and how risky it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from .traverse import adjacency, bfs, seed_frame, walk

UNKNOWN = "<unknown>"


@dataclass
class Impact:
    callers: DataFrame
    dependents: DataFrame
    dependencies: DataFrame
    files: DataFrame
    call_sites: DataFrame
    risk: DataFrame


def files_affected(callers: DataFrame) -> DataFrame:
    """(file, n_symbols, examples): distinct callers' names by file, five of them named."""
    by = callers.groupBy(F.coalesce("file", F.lit(UNKNOWN)).alias("file")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return by.select("file", F.size("names").alias("n_symbols"), F.array_join(F.slice("names", 1, 5), ", ").alias("examples"))


def call_sites(g: SymbolGraph, node_id: str) -> DataFrame:
    """(caller, site, call_style): every call edge into a node, placed by the caller's file and line."""
    e = g.edges.where((F.col("dst") == node_id) & (F.col("kind") == "calls")).select(F.col("src").alias("id"), "call_style", F.col("ord").alias("edge_ord"))
    n = g.nodes.select("id", "file", "start_line")
    return e.join(n, "id").select(F.col("id").alias("caller"), F.concat_ws(":", F.coalesce("file", F.lit(UNKNOWN)), F.col("start_line").cast("string")).alias("site"), F.coalesce("call_style", F.lit("direct")).alias("call_style"))


def risk(g: SymbolGraph, node_id: str, callers: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(files, sites, dependencies, score, level) of one node."""
    files = callers.where("file is not null").agg(F.countDistinct("file").alias("files"))
    sites = call_sites(g, node_id).agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.bool_or(F.col("call_style") == "method"), F.lit(False)).alias("by_method"))
    needs = dependencies.agg(F.count(F.lit(1)).alias("dependencies"))
    me = g.nodes.where(F.col("id") == node_id).select(F.coalesce(F.col("visibility") == "pub", F.lit(False)).alias("public"))
    score = 3 * F.col("files") + F.col("sites") + F.when(F.col("public") & (F.col("sites") > 0), 3).otherwise(0) + F.when(F.col("by_method"), 2).otherwise(0) + F.when(F.col("dependencies") > 20, 2).otherwise(0)
    level = F.when(F.col("score") <= 2, "low").when(F.col("score") <= 7, "medium").when(F.col("score") <= 14, "high").otherwise("critical")
    return me.crossJoin(files).crossJoin(sites).crossJoin(needs).withColumn("score", score).withColumn("level", level).select("files", "sites", "dependencies", "score", "level")


def impact(g: SymbolGraph, node_id: str, depth: int = 2, limit: int | None = 100) -> Impact:
    callers = walk(g, node_id, "in", ("calls",), depth, limit)
    dependents = walk(g, node_id, "in", (), depth, limit)
    dependencies = walk(g, node_id, "out", (), depth, limit)
    return Impact(callers, dependents, dependencies, files_affected(callers), call_sites(g, node_id), risk(g, node_id, callers, dependencies))


def hints(level: str, n_files: int, n_sites: int, public: bool, by_method: bool, n_dependencies: int) -> list[str]:
    """Advice for whoever changes the symbol."""
    out = [f"Its callers are spread over {n_files} file(s) at {n_sites} call site(s)."]
    if public and n_sites:
        out.append("It is public: keep the signature, or change every caller in the same step.")
    if by_method:
        out.append("It is called as a method, where resolution by name is less certain.")
    if n_dependencies > 20:
        out.append(f"It rests on {n_dependencies} other symbols; look at these first.")
    out.append({"low": "Run the tests of its file.", "medium": "Run the whole test suite."}.get(level, "Run the whole test suite and the linter, and review each caller."))
    return out


def risks(g: SymbolGraph, ids: list[str], depth: int = 2, limit: int | None = 100) -> DataFrame:
    """(id, files, sites, dependencies, score, level) of many nodes by two walks, not two for each."""
    seeds = seed_frame(g, *ids)
    known = g.nodes.select(F.col("id").alias("node"))
    up = bfs(adjacency(g.edges, "in", ("calls",)), seeds, depth, limit, known=known)
    down = bfs(adjacency(g.edges, "out"), seeds, depth, limit, known=known)
    where = g.nodes.select(F.col("id").alias("node"), "file")
    files = up.join(where, "node").groupBy("seed").agg(F.countDistinct("file").alias("files"))
    needs = down.groupBy("seed").agg(F.count(F.lit(1)).alias("dependencies"))
    calls = g.edges.where(F.col("dst").isin(ids) & (F.col("kind") == "calls")).groupBy(F.col("dst").alias("seed")).agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.bool_or(F.col("call_style") == "method"), F.lit(False)).alias("by_method"))
    me = g.nodes.where(F.col("id").isin(ids)).select(F.col("id").alias("seed"), F.coalesce(F.col("visibility") == "pub", F.lit(False)).alias("public"))
    all_ = me.join(files, "seed", "left").join(needs, "seed", "left").join(calls, "seed", "left").fillna(0, ["files", "sites", "dependencies"]).fillna(False, ["by_method"])
    score = 3 * F.col("files") + F.col("sites") + F.when(F.col("public") & (F.col("sites") > 0), 3).otherwise(0) + F.when(F.col("by_method"), 2).otherwise(0) + F.when(F.col("dependencies") > 20, 2).otherwise(0)
    level = F.when(F.col("score") <= 2, "low").when(F.col("score") <= 7, "medium").when(F.col("score") <= 14, "high").otherwise("critical")
    return all_.withColumn("score", score).withColumn("level", level).select(F.col("seed").alias("id"), "files", "sites", "dependencies", "score", "level")


def advice(level: str, tests: list[str], integration: bool = False) -> list[str]:
    """Commands to run after a change: the nearest tests, more of them the higher the risk."""
    out = [f"cargo test {t}" for t in tests[:5]]
    if level in ("medium", "high", "critical"):
        out.append("cargo test")
    if level in ("high", "critical"):
        out.append("cargo clippy --all-targets")
        if integration:
            out.append("cargo test --tests")
    return out
