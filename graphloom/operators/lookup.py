"""Finding nodes: by name, by text, by predicate; and what is next to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..graph import SymbolGraph

FILTERED_KINDS = ("function", "method", "struct", "enum", "trait")


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


def find_nodes(g: SymbolGraph, query: str) -> DataFrame:
    """Nodes of the best tier that has any: exact id or qualified name, then name, then qualified suffix.

    An id also matches without its last character, if that is a digit or ``#``.
    """
    q = F.lit(query)
    less = F.when(F.col("id").rlike("[#0-9]$"), F.expr("substring(id, 1, length(id) - 1)"))
    tier = F.when((F.col("id") == q) | F.coalesce(less == q, F.lit(False)) | (F.col("qualified_name") == q), 1).when(F.col("name") == q, 2).when(F.col("qualified_name").endswith("::" + query), 3)
    found = g.nodes.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(best), "tier").orderBy("ord")


def suggest(g: SymbolGraph, query: str) -> DataFrame:
    """Up to three names nearest by edit distance."""
    near = g.nodes.select("name", "ord", F.levenshtein("name", F.lit(query)).alias("distance")).orderBy("distance", "ord").limit(3)
    return near.where(F.col("distance") < max(len(query.encode()), 5))


def require_unique(g: SymbolGraph, query: str) -> dict:
    """The one node that a query names; an error tells what else there is."""
    rows = find_nodes(g, query).select("id", "kind", "name", "qualified_name", "file").limit(11).collect()
    if not rows:
        names = [r.name for r in suggest(g, query).collect()]
        raise NotFound(f"no symbol matches `{query}`" + (f"; nearest names: {', '.join(names)}" if names else ""))
    if len(rows) > 1:
        raise Ambiguous(f"`{query}` may mean any of: {', '.join(r.qualified_name for r in rows)}")
    return rows[0].asDict()


def adjacent(g: SymbolGraph, node_id: str, direction: str, kinds: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(id, kind, qualified_name, edge_kind, weight) one edge away, in edge order."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    e = g.edges.where(F.col(here) == node_id)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    e = e.select(F.col(there).alias("id"), F.col("kind").alias("edge_kind"), "weight", F.col("ord").alias("edge_ord"))
    out = e.join(g.nodes.select("id", "kind", "qualified_name"), "id").orderBy("edge_ord")
    out = out.limit(limit) if limit is not None else out
    return out.select("id", "kind", "qualified_name", "edge_kind", "weight")


def scope_file(g: SymbolGraph, path: str, limit: int = 500) -> DataFrame:
    """What a file's module declares; a file without a module node declares by itself."""
    files = g.nodes.where((F.col("kind") == "file") & ((F.col("name") == path) | F.col("name").endswith(path) | F.col("qualified_name").endswith(path)))
    first = files.orderBy("ord").limit(1).select(F.col("id").alias("file_id"))
    via = g.edges.where("kind = 'module_file'").join(F.broadcast(first), F.col("src") == F.col("file_id")).groupBy("file_id").agg(F.min_by("dst", "ord").alias("module_id"))
    owner = first.join(via, "file_id", "left").select(F.coalesce("module_id", "file_id").alias("owner"))
    e = g.edges.where("kind = 'declares'").join(F.broadcast(owner), F.col("src") == F.col("owner"))
    return e.select(F.col("dst").alias("id"), F.col("ord").alias("edge_ord")).join(g.nodes.select("id", "kind", "qualified_name"), "id").orderBy("edge_ord").limit(limit).select("id", "kind", "qualified_name")


def scope_module(g: SymbolGraph, query: str, limit: int = 500) -> DataFrame:
    """What a module declares; of several of that name, the first that declares anything."""
    mods = find_nodes(g, query).where("kind = 'module'")
    declares = g.edges.where("kind = 'declares'").select(F.col("src").alias("id")).distinct().withColumn("has", F.lit(True))
    chosen = mods.join(declares, "id", "left").orderBy(F.coalesce("has", F.lit(False)).desc(), "ord").limit(1).select(F.col("id").alias("owner"))
    e = g.edges.where("kind = 'declares'").join(F.broadcast(chosen), F.col("src") == F.col("owner"))
    return e.select(F.col("dst").alias("id"), F.col("ord").alias("edge_ord")).join(g.nodes.select("id", "kind", "qualified_name"), "id").orderBy("edge_ord").limit(limit).select("id", "kind", "qualified_name")


def callers(g: SymbolGraph) -> DataFrame:
    """(id, n_callers, all_tests): incoming call edges of each called node."""
    calls = g.edges.where("kind = 'calls'").join(g.nodes.select(F.col("id").alias("src"), C.is_test_like(F.col("name"), F.col("file")).alias("test")), "src")
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_callers"), F.bool_and("test").alias("all_tests"))


def filter_symbols(
    nodes: DataFrame,
    g: SymbolGraph,
    *,
    visibility: str | None = None,
    no_docs: bool = False,
    dead: bool = False,
    test_only: bool = False,
    min_callers: int | None = None,
    max_callers: int | None = None,
    min_degree: int | None = None,
    max_degree: int | None = None,
) -> DataFrame:
    """Nodes that meet all the conditions that are set."""
    n = nodes.join(callers(g), "id", "left").fillna(0, ["n_callers"])
    if "degree" not in n.columns:
        n = n.join(g.degree, "id", "left").fillna(0, ["degree"])
    cond: Column = F.lit(True)
    if visibility is not None:
        cond &= F.col("visibility") == visibility
    if no_docs:
        cond &= F.coalesce(F.trim("docs"), F.lit("")) == ""
    if dead:
        cond &= F.col("kind").isin(*FILTERED_KINDS) & (F.col("n_callers") == 0)
    if test_only:
        cond &= F.col("kind").isin(*FILTERED_KINDS) & (F.col("n_callers") > 0) & F.col("all_tests")
    for column, low, high in (("n_callers", min_callers, max_callers), ("degree", min_degree, max_degree)):
        if low is not None:
            cond &= F.col(column) >= low
        if high is not None:
            cond &= F.col(column) <= high
    return n.where(cond)


def ranked_nodes(g: SymbolGraph, query: str, limit: int | None = 50, points: int = 20, with_project: bool = False, need_text: bool = False) -> DataFrame:
    """(id, kind, qualified_name, score): text search with degree as a tie of merit.

    Without a term every node scores 1 and its degree.
    """
    words = C.terms(query)
    n = g.ranked if with_project else g.ranked.where("kind != 'project'")
    if not words:
        n = n.withColumn("score", F.lit(1) + F.col("degree")) if not need_text else n.where("false").withColumn("score", F.col("degree"))
    else:
        n = n.withColumn("text", C.hits(C.haystack(), words, points)).where("text > 0").withColumn("score", F.col("text") + F.col("degree"))
    n = n.orderBy(F.desc("score"), "kind", "qualified_name", "id") if not need_text else n.orderBy(F.desc("score"), "qualified_name", "id")
    n = n.limit(limit) if limit is not None else n
    return n.select("ord", "id", "kind", "name", "qualified_name", "file", "visibility", "docs", "degree", "score")


def search_nodes(g: SymbolGraph, query: str, limit: int = 6) -> DataFrame:
    """The guide's search: 25 points a term, projects included, a term is needed."""
    return ranked_nodes(g, query, limit, 25, True, True)


def symbols(g: SymbolGraph, query: str = "", kind: str | None = None, limit: int | None = 50, filter_first: bool = False, **conditions) -> DataFrame:
    """Ranked nodes that meet the conditions; the limit applies before them unless ``filter_first``."""
    n = ranked_nodes(g, query, None if filter_first else limit)
    if kind:
        n = n.where(F.col("kind") == kind)
    n = filter_symbols(n, g, **conditions)
    if filter_first and limit is not None:
        n = n.orderBy(F.desc("score"), "kind", "qualified_name", "id").limit(limit)
    return n


def file_symbols(g: SymbolGraph, file: str) -> DataFrame:
    """The symbols of a file from top to bottom."""
    return g.nodes.where((F.col("file") == file) & ~C.is_container(F.col("kind"))).orderBy("start_line", "ord").select("id", "kind", "start_line")


def symbol_facts(g: SymbolGraph, query: str, limit: int = 20, children: int = 40) -> DataFrame:
    """(id, child_id): nodes whose text holds a term of three letters or more, with what they declare."""
    words = [w for w in C.terms(query) if len(w) > 2]
    found = g.nodes.where(C.hits(C.haystack(), words, 1) > 0) if words else g.nodes.where("signature is not null")
    found = found.orderBy("ord").limit(limit).select("id")
    e = g.edges.where(F.col("kind").isin("declares", "has_method", "contains")).select(F.col("src").alias("id"), F.col("dst").alias("child_id"), F.col("ord").alias("edge_ord"))
    kids = found.join(e, "id").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("edge_ord"))).where(F.col("r") <= children)
    return found.join(kids.select("id", "child_id"), "id", "left")


def similar(g: SymbolGraph, node_id: str, limit: int = 20) -> DataFrame:
    """(id, shared, signature_score, score): nodes of the same kind with common callees or like signatures."""
    words = SIGNATURE_WORDS
    me = g.nodes.where(F.col("id") == node_id).select(F.col("kind").alias("my_kind"), F.coalesce("signature", F.lit("")).alias("my_signature"))
    calls = g.edges.where("kind = 'calls'").select("src", "dst").distinct()
    mine = calls.where(F.col("src") == node_id).select("dst")
    shared = calls.where(F.col("src") != node_id).join(F.broadcast(mine), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("shared"))
    n = g.nodes.where((F.col("id") != node_id) & ~C.is_container(F.col("kind"))).join(F.broadcast(me), F.col("kind") == F.col("my_kind")).join(shared, "id", "left").fillna(0, ["shared"])
    sig = F.coalesce("signature", F.lit(""))
    agree = F.lit(0)
    for w in words:
        agree = agree + F.when(F.contains(sig, F.lit(w)) == F.contains(F.col("my_signature"), F.lit(w)), 1).otherwise(0)
    agree = F.when((sig == "") | (F.col("my_signature") == ""), 0).otherwise(agree)
    n = n.withColumn("signature_score", agree).withColumn("score", 3 * F.col("shared") + F.col("signature_score")).where("score > 0")
    return n.orderBy(F.desc("score"), "qualified_name", "id").limit(limit).select("id", "shared", "signature_score", "score")


SIGNATURE_WORDS = tuple(sorted("async|bool|fn|pub|self|unsafe|&mut self|&self|&str|i32|i64|u32|u64|HashMap|Option|PathBuf|Result|String|Vec|io::Result".split("|")))
