"""Churn, ownership and co-change from commit histories: (commit, author, file) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from ..runtime import spread
from .metrics import file_degrees


def relevant(commits: DataFrame) -> DataFrame:
    """Distinct (commit, author, file) of source files and manifests."""
    return commits.where(F.col("file").endswith(".rs") | F.col("file").endswith("Cargo.toml")).select("commit", "author", "file").distinct()


def churn(commits: DataFrame) -> DataFrame:
    """(file, churn): how many commits changed it."""
    once = relevant(commits.withColumn("author", F.lit(None).cast("string")))
    return once.groupBy("file").agg(F.count("commit").alias("churn"))


def owners(commits: DataFrame, rows: int = 0) -> DataFrame:
    """(file, author, n): who changed a file most often; of equals, the first by name.  ``rows`` is about how many commits and files there are."""
    n = spread(relevant(commits).select("file", "author"), "file", "author", rows=rows).groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("author"))).alias("b")).select("file", F.col("b.author").alias("author"), (-F.col("b.m")).alias("n"))


def cochange(commits: DataFrame) -> DataFrame:
    """(a, b, n): pairs of files changed by the same commit.

    Pairs come from each commit's own sorted list, so a commit is never joined with itself by shuffle twice.
    """
    c = relevant(commits).groupBy("commit").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files") > 1)
    one = c.select("files", F.posexplode("files").alias("p", "a"))
    two = one.select("a", F.explode(F.expr("slice(files, p + 2, size(files))")).alias("b"))
    return two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def hotspots(g: SymbolGraph, commits: DataFrame) -> DataFrame:
    """(file, churn, degree, risk): churn plus the degree of the file in the graph.

    A path that the graph does not have takes the degree of the first graph
    file, in order, that ends it; paths are compared by suffix keys, not pairwise.
    """
    c = churn(commits)
    d = file_degrees(g)
    parts = F.split("file", "/")
    suffixes = c.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))
    near = suffixes.join(d.withColumnRenamed("file", "key"), "key").groupBy("file").agg(F.min_by("degree", F.struct((F.col("key") != F.col("file")).alias("inexact"), F.col("key"))).alias("degree"))
    return c.join(near, "file", "left").fillna(0, ["degree"]).withColumn("risk", F.col("churn") + F.col("degree"))


def changed_targets(targets: DataFrame, changed: DataFrame) -> DataFrame:
    """Targets (name, src_path) that a change touches: a changed file ends the path, or lies in ``src/``."""
    parts = F.split("src_path", "/")
    keys = targets.select("name", "src_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("file"))
    hit = keys.join(changed.select("file").distinct(), "file", "left_semi").select("name", "src_path")
    any_src = changed.where(F.col("file").startswith("src/")).limit(1).select(F.lit(1).alias("__any"))
    return hit.unionByName(targets.select("name", "src_path").crossJoin(F.broadcast(any_src)).drop("__any")).distinct()


def top(df: DataFrame, *order: str, limit: int = 20) -> DataFrame:
    """The first rows, descending by the first column, ascending by the others."""
    return df.orderBy(F.desc(order[0]), *order[1:]).limit(limit)
