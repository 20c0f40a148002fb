"""The handle of a graph: its node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import ClassVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class SymbolGraph:
    """``nodes`` (ord, id, kind, name, qualified_name, file, start_line, ...) and ``edges`` (ord, src, dst, kind, weight, ...).

    ``ord`` is the order in which rows were met; ties are broken by it.
    """

    nodes: DataFrame
    edges: DataFrame
    packages: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    profiles: list[dict] = field(default_factory=list)
    root: str = ""
    #: Of a source that knows them and whose ids are all different: (kind, certainty, f, t, f_box, t_box, n, weight), edges counted by
    #: their ends' files, null where there is none, and whether the ends are containers; none of an impl's method.
    by_files: ClassVar[DataFrame | None] = None
    #: Likewise (ord, src, dst, kind, src_name, dst_name), the names of an edge's ends, null for one that is no node.
    named: ClassVar[DataFrame | None] = None

    def persist(self) -> SymbolGraph:
        """Keeps both tables in executors' memory and disk; a lost block is computed again."""
        return replace(self, nodes=self.nodes.persist(StorageLevel.MEMORY_AND_DISK), edges=self.edges.persist(StorageLevel.MEMORY_AND_DISK))

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    @cached_property
    def degree(self) -> DataFrame:
        """(id, degree): the weights of all edges at either end."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
        return ends.groupBy("id").agg(F.sum("weight").alias("degree"))

    @cached_property
    def ranked(self) -> DataFrame:
        """Nodes with their degree, 0 without an edge."""
        return self.nodes.join(self.degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def views(self, prefix: str = "") -> None:
        """Registers the tables for SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
