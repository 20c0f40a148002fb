"""Edges from outside: the compiler's intermediate text and the language server's answers, read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import link

#: Calls that say nothing about the project.
_SKIP = r"^(std|core|alloc)::|(^|::)(drop|drop_in_place|clone|into|from|default)$"
#: Kinds by the protocol's numbers.
SYMBOL_KINDS = {2: "module", 5: "struct", 6: "method", 7: "property", 8: "field", 9: "constructor", 10: "enum", 11: "trait", 12: "function", 13: "variable", 14: "const", 22: "enum_member", 23: "struct", 26: "type_parameter"}


def mir_calls(lines: DataFrame) -> DataFrame:
    """(owner, target) of (line_no, value): ``fn`` lines set the owner, ``x = callee(..) -> `` lines are its calls.

    Lines of several outputs have a column ``file`` and are taken file by file.
    """
    w = Window.partitionBy(*(["file"] if "file" in lines.columns else [])).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("value", r"^fn ([^(]+)\(", 1)
    call = F.regexp_extract("value", r"= ([^=(]+)\(.*\) -> ", 1)
    rows = lines.select("line_no", F.last(F.when(head != "", head), True).over(w).alias("owner"), F.regexp_replace(F.trim(call), "::<.*>", "").alias("target"))
    return rows.where((F.col("target") != "") & F.col("owner").isNotNull() & ~F.col("target").rlike(_SKIP)).select("owner", "target").distinct()


def mir_edges(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed call edges; ends resolve by qualified name, else by a unique short name."""
    calls = mir_calls(lines).withColumn("ord", F.monotonically_increasing_id())
    find = lambda df, column: link.resolve(df.withColumn("target", F.col(column)).withColumns({"file": F.lit(None).cast("string"), "strategy": F.lit("callable")}), nodes)
    owners = find(calls.select("ord", "owner", F.col("target").alias("callee")), "owner").select("ord", F.col("dst").alias("src"), "callee")
    both = find(owners, "callee").select("src", "dst")
    return confirmed(both, "mir")


def confirmed(pairs: DataFrame, source: str) -> DataFrame:
    return pairs.where("src != dst").select("src", "dst", F.lit("calls").alias("kind"), F.lit(1).cast("bigint").alias("weight"), F.lit(source).alias("source"), F.lit("confirmed").alias("certainty"))


def flatten_symbols(symbols: list[dict], file: str) -> list[tuple]:
    """(file, name, kind, line) of a document's symbols and their children, parents first."""
    out = []
    for s in symbols:
        line = (s.get("selectionRange") or s.get("range") or s["location"]["range"])["start"]["line"] + 1
        out.append((file, s["name"], SYMBOL_KINDS.get(s["kind"], "unknown"), line))
        out += flatten_symbols(s.get("children") or [], file)
    return out


def confirm_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``confirmed``: (file, name, kind, line) names the node by its line, or is the only one of its name there."""
    exact = symbols.select("file", "name", F.col("line").alias("start_line")).distinct().withColumn("__x", F.lit(True))
    only = nodes.groupBy("file", "name").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").join(symbols.select("file", "name").distinct(), ["file", "name"]).withColumn("__u", F.lit(True)).drop("__n")
    out = nodes.join(exact, ["file", "name", "start_line"], "left").join(only, ["file", "name"], "left")
    return out.withColumn("confirmed", F.coalesce("__x", "__u", F.lit(False))).drop("__x", "__u")
