"""Walks over the edges: one breadth-first loop, and what is built on it.

A level is one join of the frontier with the edges, one aggregate that keeps
each node's first discoverer, and one anti join with what was seen before.
Levels are written to the shared folder, so a lost executor costs no more than
the level under way.  A frontier of a checked size goes to the edges, which then
are only scanned; a larger one meets edges that were shuffled once for the walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..graph import SymbolGraph
from ..runtime import saved

SEEN = "seed string, node string, depth int, parent string, edge_ord bigint, rank array<bigint>"
#: A frontier of up to so many rows is sent to every task.
HELD = 100_000
#: Beyond, the steps out of a node lie in so many partitions, so that a node with a large share of all edges is split.
SALT = 16


def adjacency(edges: DataFrame, direction: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(node, next, edge_ord): edges as steps out of ``node``; ``both`` takes them either way."""
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("ord").alias("edge_ord"))
    back = e.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.col("ord").alias("edge_ord"))
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


class Steps:
    """Steps that frontiers of any size meet."""

    def __init__(self, steps: DataFrame, held: int) -> None:
        self.steps, self.held, self.placed = steps, held, None

    def meet(self, frontier: DataFrame, size: int) -> DataFrame:
        """The frontier, whose column ``parent`` is a node, joined with the steps out of it."""
        if size <= self.held:
            return F.broadcast(frontier).join(self.steps, F.col("parent") == F.col("node"))
        if self.placed is None:
            self.placed = self.steps.withColumn("__s", F.pmod(F.xxhash64("next"), F.lit(SALT)).cast("int")).repartition("node", "__s").persist(StorageLevel.MEMORY_AND_DISK)
        salted = frontier.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        return salted.join(self.placed, (F.col("parent") == F.col("node")) & (F.col("__t") == F.col("__s")))

    def release(self) -> None:
        if self.placed is not None:
            self.placed.unpersist()


def bfs(steps: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None, keep_start: bool = False, known: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """(seed, node, depth, parent, edge_ord, rank): nodes within ``depth`` steps of each seed.

    ``seeds`` has a column ``seed``; ``known``, if given, a column ``node`` with
    all nodes that may be entered.  Each node appears once, by its first
    discoverer; ``rank``, the numbers of the edges that lead to it, orders nodes
    of a level as a queue would meet them.  With ``limit`` a parent is expanded
    only while fewer than that many nodes have been found before it, so the last
    expansion may exceed it.  ``keep_start`` counts the seed as seen; else it
    shows up again where a cycle leads to it.
    """
    spark = steps.sparkSession
    met = Steps(steps, held)
    frontier = saved(seeds.select("seed", F.col("seed").alias("node"), F.array().cast("array<bigint>").alias("rank")).distinct())
    size = frontier.count()
    levels = [frontier.select("seed", "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("bigint").alias("edge_ord"), "rank")] if keep_start else []
    total = size if keep_start else 0
    for level in range(1, depth + 1):
        here = frontier.select("seed", F.col("node").alias("parent"), F.col("rank").alias("parent_rank"))
        step = met.meet(here, size).select("seed", F.col("next").alias("node"), F.struct("parent_rank", "edge_ord", "parent").alias("by"))
        new = step.groupBy("seed", "node").agg(F.min("by").alias("by"))
        if levels:
            seen = reduce(DataFrame.unionByName, (x.select("seed", "node") for x in levels))
            new = new.join(F.broadcast(seen) if total <= held else seen, ["seed", "node"], "left_anti")
        if known is not None:
            new = new.join(known.select("node"), "node", "left_semi")
        new = new.select("seed", "node", "by.*")
        if limit is not None:
            # while anything is expanded fewer than ``limit`` nodes of a seed are known, so are its parents
            counts = new.groupBy("seed", "parent_rank").agg(F.count(F.lit(1)).alias("n"))
            before = F.coalesce(F.sum("n").over(Window.partitionBy("seed").orderBy("parent_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            found = spark.createDataFrame([], "seed string, total bigint")
            for x in levels:
                found = found.unionByName(x.where("depth > 0").groupBy("seed").agg(F.count(F.lit(1)).alias("total")))
            found = found.groupBy("seed").agg(F.sum("total").alias("total"))
            open_ = counts.withColumn("before", before).join(found, "seed", "left").where(F.col("before") + F.coalesce("total", F.lit(0)) < limit)
            new = new.join(open_.select("seed", "parent_rank"), ["seed", "parent_rank"])
        frontier = saved(new.select("seed", "node", F.lit(level).alias("depth"), "parent", "edge_ord", F.concat("parent_rank", F.array("edge_ord")).alias("rank")))
        size = frontier.count()
        if not size:
            break
        levels.append(frontier)
        total += size
    met.release()
    out = spark.createDataFrame([], SEEN)
    for x in levels:
        out = out.unionByName(x)
    return out if keep_start else out.where("depth > 0")


def seed_frame(g: SymbolGraph, *ids: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "seed string")


def walk(g: SymbolGraph, node_id: str, direction: str, kinds: tuple[str, ...] = (), depth: int = 2, limit: int | None = 100, keep_start: bool = False) -> DataFrame:
    """(id, kind, qualified_name, file, depth, parent): what a node reaches, or is reached from."""
    found = bfs(adjacency(g.edges, direction, kinds), seed_frame(g, node_id), depth, limit, keep_start, g.nodes.select(F.col("id").alias("node")))
    return found.join(g.nodes.select(F.col("id").alias("node"), "kind", "name", "qualified_name", "file"), "node").select(F.col("node").alias("id"), "kind", "name", "qualified_name", "file", "depth", "parent", "rank")


def trace(g: SymbolGraph, node_id: str, direction: str = "both", depth: int = 2, limit: int | None = 100) -> DataFrame:
    """Callers (up) and callees (down), marked by ``way``."""
    ways = {"up": ("in",), "down": ("out",), "both": ("in", "out")}[direction]
    parts = [walk(g, node_id, w, ("calls",), depth, limit).withColumn("way", F.lit("up" if w == "in" else "down")) for w in ways]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shortest_path(g: SymbolGraph, start: str, end: str, max_depth: int = 6) -> DataFrame:
    """(position, id) of a shortest directed path over all edges; none if there is none of up to ``max_depth`` steps.

    Of equal paths it is the one whose ids come first in order, step by step.
    """
    spark = g.nodes.sparkSession
    if start == end:
        return g.nodes.where(F.col("id") == start).limit(1).select(F.lit(0).alias("position"), "id")
    steps = Steps(g.edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), HELD)
    frontier = saved(spark.createDataFrame([(start, [start])], "node string, path array<string>"))
    levels, size, total = [frontier], 1, 1
    for _ in range(max_depth):
        step = steps.meet(frontier.select(F.col("node").alias("parent"), "path"), size)
        new = step.groupBy(F.col("next").alias("node")).agg(F.min("path").alias("path"))
        seen = reduce(DataFrame.unionByName, (x.select("node") for x in levels))
        new = new.join(F.broadcast(seen) if total <= HELD else seen, "node", "left_anti")
        frontier = saved(new.select("node", F.concat("path", F.array("node")).alias("path")))
        n = frontier.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.bool_or(F.col("node") == end), F.lit(False)).alias("there")).first()
        if n.there or not n.size:
            break
        levels.append(frontier)
        size, total = n.size, total + n.size
    steps.release()
    return frontier.where(F.col("node") == end).select(F.posexplode("path").alias("position", "id"))


def closure_sizes(pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(start, reached): how many others each start of (f, t) pairs reaches within ``depth`` steps."""
    steps = saved(pairs.select(F.col("f").alias("node"), F.col("t").alias("next"), F.lit(0).cast("bigint").alias("edge_ord")).distinct())
    found = bfs(steps, steps.select(F.col("node").alias("seed")).distinct(), depth)
    return found.where("node != seed").groupBy(F.col("seed").alias("start")).agg(F.count(F.lit(1)).alias("reached"))


def neighborhood(g: SymbolGraph, node_id: str, depth: int = 2, kinds: tuple[str, ...] = (), sources: tuple[str, ...] = (), certainties: tuple[str, ...] = (), max_nodes: int | None = 180) -> DataFrame:
    """(id, depth): nodes around one, edges taken either way, filtered by kind, source and certainty."""
    e = g.edges
    for column, values in (("kind", kinds), ("source", sources), ("certainty", certainties)):
        if values:
            e = e.where(F.col(column).isin(*values))
    found = bfs(adjacency(e, "both"), seed_frame(g, node_id), depth, None, True).orderBy("depth", "rank")
    found = found.limit(max_nodes) if max_nodes is not None else found
    return found.select(F.col("node").alias("id"), "depth")


def read_order(g: SymbolGraph, roots: list[str], limit: int = 20) -> DataFrame:
    """(position, id): each root, then what it declares, holds or calls, without repeats of a place."""
    spark = g.nodes.sparkSession
    r = spark.createDataFrame(list(enumerate(roots)), "root_rank int, id string")
    kids = g.edges.where(F.col("kind").isin("declares", "module_file", "calls")).select(F.col("src").alias("root"), F.col("dst").alias("id"), F.col("ord").alias("pos"))
    both = r.select("root_rank", "id", F.lit(0).cast("bigint").alias("pos")).unionByName(kids.join(F.broadcast(r.withColumnRenamed("id", "root")), "root").select("root_rank", "id", "pos"))
    n = g.nodes.where(C.is_readable(F.col("kind"))).select("id", F.concat_ws(":", F.coalesce("file", "id"), F.coalesce(F.col("start_line").cast("string"), F.lit("0"))).alias("place"))
    placed = both.join(n, "id").groupBy("place").agg(F.min(F.struct("root_rank", "pos", "id")).alias("f"))
    first = placed.orderBy("f.root_rank", "f.pos", "f.id").limit(limit).select("f.*")
    return first.select((F.row_number().over(Window.orderBy("root_rank", "pos", "id")) - 1).alias("position"), "id")


def test_impact(g: SymbolGraph, query: str, depth: int = 4, limit: int = 50) -> DataFrame:
    """(test, depth, score): tests whose calls reach a symbol; the nearer, the higher."""
    target = g.nodes.where((F.col("name") == query) | (F.col("qualified_name") == query) | F.col("qualified_name").endswith("::" + query)).select("id").limit(2).collect()
    if len(target) != 1:
        return static_tests(g, query, limit).select("id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("double").alias("score"))
    found = walk(g, target[0].id, "in", ("calls",), depth, None, True)
    tests = found.where((F.col("depth") > 0) & F.col("kind").isin("function", "method") & C.is_test_like(F.col("name"), F.col("file")))
    return tests.withColumn("score", F.lit(1.0) / F.col("depth")).orderBy(F.desc("score"), "qualified_name", "id").limit(limit).select("id", "depth", "score")


def static_tests(g: SymbolGraph, text: str = "", limit: int = 50) -> DataFrame:
    """Functions that look like tests, those that mention ``text`` if it is given."""
    n = g.nodes.where(F.col("kind").isin("function", "method") & C.is_test_like(F.col("name"), F.col("file")))
    if text:
        n = n.where(F.contains(F.concat_ws(" ", "name", "qualified_name", "file"), F.lit(text)))
    return n.orderBy("ord").limit(limit).select("id", "qualified_name", "file")
