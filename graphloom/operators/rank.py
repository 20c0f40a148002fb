"""Staged retrieval: lexical candidates, then embeddings, then a second scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..graph import SymbolGraph

#: Bytes of a signature or docs that enter a node's text.
CUT = 420


def prior(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), 9).when(kind.isin("struct", "enum", "trait", "impl", "type_alias"), 7).when(kind.isin("module", "file"), 5).otherwise(1)


def document_text(g: SymbolGraph) -> DataFrame:
    """(id, kind, text) of nodes worth retrieving."""
    cut = lambda c: F.when(F.length(c) > CUT, F.concat(F.substring(c, 1, CUT), F.lit("..."))).otherwise(F.coalesce(c, F.lit("")))
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in (("name", F.col("name")), ("qualified", F.col("qualified_name")), ("kind", F.col("kind")), ("file", F.coalesce("file", F.lit(""))), ("visibility", F.coalesce("visibility", F.lit(""))), ("signature", cut(F.col("signature"))), ("docs", cut(F.col("docs"))))]
    return g.nodes.where(C.is_readable(F.col("kind"))).select("id", "kind", "qualified_name", F.concat_ws("\n", *lines).alias("text"))


def lexical(texts: DataFrame, query: str, points: int = 25) -> DataFrame:
    """Adds ``lexical``: points for each term in ``text``, and the prior of ``kind`` if there is one."""
    base = prior(F.col("kind")) if "kind" in texts.columns else F.lit(0)
    return texts.withColumn("lexical", (C.hits(F.lower("text"), C.terms(query), points) + base).cast("double"))


def score() -> Column:
    """A rerank score decides, else the embedding, else the text."""
    return F.when(F.col("rerank").isNotNull(), F.col("rerank") * 1000).when(F.col("embedding_score").isNotNull(), F.col("embedding_score") * 100 + F.col("lexical")).otherwise(F.col("lexical"))


def cascade(texts: DataFrame, query: str, embeddings: DataFrame | None = None, query_vector: list[float] | None = None, rerank: DataFrame | None = None, limit: int = 10, candidates: int = 80) -> DataFrame:
    """(id, score): the best of each stage goes on to the next; a stage without data is skipped.

    ``embeddings`` has (id, embedding), ``rerank`` (id, rerank).
    """
    c = lexical(texts, query).orderBy(F.desc("lexical"), "id").limit(max(candidates, limit)).withColumn("embedding_score", F.lit(None).cast("double")).withColumn("rerank", F.lit(None).cast("double"))
    if embeddings is not None and query_vector is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        c = c.drop("embedding_score").join(embeddings.select("id", C.cosine(F.col("embedding"), q).alias("embedding_score")), "id", "left")
        c = c.orderBy(F.desc(score()), "id").limit(max(min(candidates, 48), limit))
    if rerank is not None:
        c = c.drop("rerank").join(rerank.select("id", F.col("rerank").cast("double")), "id", "left")
    return c.withColumn("score", score()).orderBy(F.desc("score"), "id").limit(limit).select("id", "score")


def nearest(embeddings: DataFrame, query_vector: list[float], limit: int = 10) -> DataFrame:
    """(id, similarity) of the vectors nearest to one."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return embeddings.select("id", C.cosine(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)


def retrieve(g: SymbolGraph, query: str, limit: int = 10, candidates: int = 80, **stages) -> DataFrame:
    """The cascade over a graph's nodes."""
    return cascade(document_text(g), query, limit=limit, candidates=candidates, **stages)
