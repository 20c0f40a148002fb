"""Counts, degrees, scores and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..graph import SymbolGraph


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def stats(g: SymbolGraph) -> DataFrame:
    """(aspect, key, n): nodes by kind, edges by kind, source and certainty, files, symbols, all nodes and edges."""
    by = F.explode(F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(c).alias("key")) for a, c in (("edge_kind", "kind"), ("source", "source"), ("certainty", "certainty")))))
    edges = g.edges.select(by.alias("s")).groupBy("s.aspect", "s.key").agg(F.count(F.lit(1)).alias("n"))
    nodes = g.nodes.groupBy(F.lit("node_kind").alias("aspect"), F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = nodes.agg(F.sum("n").alias("nodes"), F.sum(F.when(F.col("key") == "file", F.col("n"))).alias("files"), F.sum(F.when(~F.col("key").isin("project", "crate", "file"), F.col("n"))).alias("symbols"))
    flat = total.select(F.explode(F.array(*(F.struct(F.lit("total").alias("aspect"), F.lit(k).alias("key"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in ("nodes", "files", "symbols")))).alias("t")).select("t.*")
    return nodes.unionByName(edges).unionByName(flat)


def hot_symbols(g: SymbolGraph, limit: int = 20) -> DataFrame:
    """Symbols of highest degree."""
    return g.ranked.where(~C.is_container(F.col("kind"))).orderBy(F.desc("degree"), "qualified_name", "id").limit(limit).select("id", "kind", "qualified_name", "degree")


def top_files(g: SymbolGraph, limit: int = 30) -> DataFrame:
    """File nodes by their number of edges, in and out."""
    files = g.nodes.where("kind = 'file'")
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("edges_in"), F.sum("o").alias("edges_out"))
    both = files.join(counts, "id", "left").fillna(0, ["edges_in", "edges_out"])
    return both.orderBy(F.desc(F.col("edges_in") + F.col("edges_out")), "file", "id").limit(limit).select("file", "edges_in", "edges_out", "lines")


def quality(g: SymbolGraph) -> DataFrame:
    """One row: how far the edges can be trusted, 0 to 100."""
    n = lambda *v: F.sum(F.when(F.col("certainty").isin(*v), 1).otherwise(0)).cast("bigint")
    c = g.edges.agg(n("definite", "confirmed").alias("trusted"), n("inferred").alias("inferred"), n("possible").alias("possible")).fillna(0)
    total = F.col("trusted") + F.col("inferred") + F.col("possible")
    score = F.when(total == 0, F.lit(0).cast("bigint")).otherwise(F.expr("(100 * trusted + 55 * inferred + 25 * possible) div (trusted + inferred + possible)"))
    label = F.when(F.col("score") >= 85, "high").when(F.col("score") >= 65, "medium").when(F.col("score") >= 1, "low").otherwise("empty")
    return c.withColumn("score", score).withColumn("label", label).select("score", "label", F.col("trusted").alias("trusted_edges"), (F.col("inferred") + F.col("possible")).alias("uncertain_edges"))


def clusters(g: SymbolGraph) -> DataFrame:
    """(cluster, files, nodes, symbols, degree), by degree."""
    n = g.ranked.where("file is not null").withColumn("cluster", C.cluster_key(F.col("file")))
    return n.groupBy("cluster").agg(
        F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("nodes"), F.sum(F.when(~C.is_container(F.col("kind")), 1).otherwise(0)).alias("symbols"), F.sum("degree").alias("degree")
    )


def cluster_hot_symbols(g: SymbolGraph, top: int = 8) -> DataFrame:
    """(cluster, rank, qualified_name, degree): the symbols of highest degree of each cluster."""
    n = g.ranked.where(F.col("file").isNotNull() & ~C.is_container(F.col("kind"))).withColumn("cluster", C.cluster_key(F.col("file")))
    w = Window.partitionBy("cluster").orderBy(F.desc("degree"), "qualified_name", "id")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("cluster", "rank", "qualified_name", "degree")


def entries(g: SymbolGraph, target_paths: list[str] = (), limit: int = 20) -> DataFrame:
    """(id, score): likely entry points."""
    name, file = F.col("name"), F.coalesce("file", F.lit(""))
    main_file = file.endswith("src/main.rs") | file.endswith("src/lib.rs")
    target = main_file
    for p in target_paths:
        target = target | F.lit(p).endswith(file)
    marks = [
        (name == "main", 180),
        (name.startswith("run_") | name.endswith("_handler") | name.endswith("_route"), 75),
        (F.coalesce(F.col("visibility") == "pub", F.lit(False)), 35),
        (main_file, 55),
        (target, 45),
        (F.col("kind").isin("function", "method", "trait", "struct", "enum"), 12),
    ]
    extra, reasons = F.lit(0), F.lit(0)
    for cond, points in marks:
        extra = extra + F.when(cond, points).otherwise(0)
        reasons = reasons + F.when(cond, 1).otherwise(0)
    n = g.ranked.where(F.col("kind").isin("function", "method", "trait", "struct", "enum", "file", "module")).withColumn("score", F.col("degree") + extra).withColumn("reasons", reasons)
    return n.where("reasons > 0 or score >= 10").orderBy(F.desc("score"), "file", "qualified_name", "id").limit(limit).select("id", "score", "reasons")


def file_degrees(g: SymbolGraph) -> DataFrame:
    """(file, degree): the weights of edge ends in each file."""
    if g.by_files is not None:
        ends = g.by_files.select(F.explode(F.array("f", "t")).alias("file"), "weight").where("file is not null")
        return ends.groupBy("file").agg(F.sum("weight").alias("degree"))
    # summed up by node before nodes meet their files
    return g.degree.join(g.nodes.where("file is not null").select("id", "file"), "id").groupBy("file").agg(F.sum("degree").alias("degree"))
