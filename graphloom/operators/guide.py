"""Where to start reading: roots of a question, an order to read in, and what surrounds them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from . import lookup, metrics, rank
from .traverse import adjacency, bfs, read_order, seed_frame


@dataclass
class Guide:
    roots: list[str]
    read: DataFrame
    callers: DataFrame
    callees: DataFrame
    quality: DataFrame


def guide(g: SymbolGraph, query: str = "", depth: int = 2, limit: int = 20, **stages) -> Guide:
    """Roots by retrieval if it has data, else by text; without a query, the likely entry points."""
    if query and stages:
        roots = [r.id for r in rank.retrieve(g, query, min(limit, 8), limit * 6, **stages).collect()]
    elif query:
        roots = [r.id for r in lookup.search_nodes(g, query).orderBy(F.desc("score"), "qualified_name", "id").collect()]
    else:
        roots = [r.id for r in metrics.entries(g, limit=6).orderBy(F.desc("score"), "id").collect()]
    seeds = seed_frame(g, *roots)
    around = lambda way: bfs(adjacency(g.edges, way, ("calls",)), seeds, depth, limit, True).where("depth > 0").select(F.col("seed").alias("root"), F.col("node").alias("id"), "depth")
    return Guide(roots, read_order(g, roots, limit), around("in"), around("out"), metrics.quality(g))


def overview(g: SymbolGraph, query: str = "", nodes: int = 28, edges: int = 80) -> DataFrame:
    """(src, dst, kind, weight): edges among the nodes that matter most, by degree or by search."""
    top = lookup.ranked_nodes(g, query, 50) if query else g.ranked.where("kind != 'project'").orderBy(F.desc("degree"), "id").limit(50)
    first = top.orderBy(F.desc("score"), "kind", "qualified_name", "id").limit(nodes) if query else top.orderBy(F.desc("degree"), "id").limit(nodes)
    ids = first.select("id")
    e = g.edges.join(F.broadcast(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst", "left_semi")
    return e.orderBy("ord").limit(edges).select("src", "dst", "kind", "weight")


def compact(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that a prompt needs, those that exist."""
    return df.select(*[c for c in columns or ("id", "kind", "qualified_name", "file", "start_line") if c in df.columns])
