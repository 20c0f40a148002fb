"""Graphs on disk: the JSON document that other tools read, and Parquet for this engine."""

from __future__ import annotations

import glob
import gzip
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..graph import SymbolGraph
from ..operators.sets import merge

#: Folder and file of a project's graph.
FOLDER, FILE = ".graphloom", "graph.json.gz"


def default_path(project: str = ".") -> str:
    return os.path.join(project, FOLDER, FILE)


def discover(project: str = ".") -> list[str]:
    return sorted(glob.glob(os.path.join(project, FOLDER, "*.json.gz")))


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """The document's nodes as the engine holds them."""
    return nodes.select("ord", "id", "kind", "name", "qualified_name", "file", F.col("range.start_line").alias("start_line"), F.col("range.end_line").alias("end_line"), "visibility", "signature", "docs", F.coalesce(F.element_at("metrics", "lines"), F.lit(0)).alias("lines"), "metrics")


def load(spark: SparkSession, path: str) -> SymbolGraph:
    """Reads a document; gzip is told by the content, not by the name.

    A document that lacks a field that must be there, or holds an unknown kind,
    is an error; unknown fields are ignored.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(f"no graph at {path}; index the project first")
    # the reader wants a codec by name, so the driver unpacks the one document
    with open(path, "rb") as f:
        raw = f.read()
    text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
    doc = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema.DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    found = json.loads(text)
    for part, kind in (("nodes", schema.NODE), ("edges", schema.EDGE)):
        if part not in found:
            raise ValueError(f"{path}: no {part}")
        must = [f.name for f in kind.fields if not f.nullable]
        for row in found[part]:
            if missing := [m for m in must if row.get(m) is None]:
                raise ValueError(f"{path}: one of its {part} has no {missing[0]}")
    domains = {"nodes": (("kind", schema.NODE_KINDS),), "edges": (("kind", schema.EDGE_KINDS), ("source", schema.SOURCES), ("certainty", schema.CERTAINTIES))}
    for part, columns in domains.items():
        for column, values in columns:
            if odd := {r[column] for r in found[part]} - set(values):
                raise ValueError(f"{path}: unknown {column} {sorted(odd)[0]!r}")
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select(F.col("ord").cast("bigint"), "n.*")
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select(F.col("ord").cast("bigint"), "e.*").withColumnsRenamed({"from": "src", "to": "dst"})
    project = found.get("project") or {}
    return SymbolGraph(flat_nodes(nodes), edges, project.get("packages") or [], found.get("warnings") or [], found.get("profiles") or [], project.get("root") or "")


def load_many(spark: SparkSession, paths: list[str] = (), project: str = ".") -> SymbolGraph:
    """No path: the project's own graph, else all in its folder; several: their union."""
    if not paths:
        own = default_path(project)
        paths = [own] if os.path.exists(own) else discover(project) or [own]
    return merge([load(spark, p) for p in paths])


def save(g: SymbolGraph, path: str) -> None:
    """Writes the JSON document, gzipped whatever its name.

    One document is one file, so this gathers the graph on the driver; large
    graphs go to :func:`save_tables`.
    """
    metrics = F.col("metrics") if "metrics" in g.nodes.columns else F.create_map(F.lit("lines"), F.coalesce("lines", F.lit(0)).cast("bigint"))
    end = F.col("end_line") if "end_line" in g.nodes.columns else F.col("start_line")
    range_ = F.when(F.col("start_line").isNotNull(), F.struct("start_line", end.alias("end_line")))
    nodes = g.nodes.orderBy("ord").select("id", "kind", "name", "qualified_name", "file", range_.alias("range"), "visibility", "signature", "docs", metrics.alias("metrics"))
    e = g.edges
    for name, default in (("label", F.lit(None).cast("string")), ("evidence", F.lit(None).cast(schema.EVIDENCE)), ("call_style", F.lit(None).cast("string")), ("profiles", F.array().cast(T.ArrayType(T.StringType())))):
        if name not in e.columns:
            e = e.withColumn(name, default)
    edges = e.orderBy("ord").select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "label", "evidence", "weight", "source", "certainty", "call_style", "profiles")
    row = lambda d: [json.loads(r[0]) for r in d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    doc = {"schema_version": 2, "project": {"root": g.root, "workspace_root": g.root, "packages": g.packages}, "nodes": row(nodes), "edges": row(edges), "warnings": g.warnings, "profiles": g.profiles, "generated_at_ms": int(time.time() * 1000)}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with gzip.open(path, "wt") as f:
        json.dump(doc, f)


def save_tables(g: SymbolGraph, folder: str) -> None:
    """Parquet; edges by kind, so that a query of one kind reads no other."""
    g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")


def load_tables(spark: SparkSession, folder: str) -> SymbolGraph:
    return SymbolGraph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))
