"""Texts for readers: a map within a budget, a report, and answers as JSON.

These gather small, already limited results on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from . import health as H
from . import metrics as M

CUT = "\n... (cut)\n"


def within(text: str, budget: int) -> str:
    """The text, cut at a character so that it takes no more than ``budget`` bytes."""
    raw = text.encode()
    return text if len(raw) <= budget else raw[: max(0, budget - len(CUT.encode()))].decode(errors="ignore") + CUT


def to_rows(df: DataFrame) -> list[dict]:
    """A result as JSON objects; nulls are written."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def to_json(kind: str, df: DataFrame, **more) -> str:
    """One JSON document of a result."""
    rows = to_rows(df)
    return json.dumps({"kind": kind, **more, "count": len(rows), "rows": rows}, ensure_ascii=False)


def repo_map(g: SymbolGraph, budget: int = 8000, top: int = 20) -> str:
    """Markdown: counts, clusters with their main symbols, entry points."""
    out = ["# Map", ""]
    out += [f"- {r.key}: {r.n}" for r in M.stats(g).where("aspect = 'total'").orderBy("key").collect()]
    names: dict[str, list[str]] = {}
    for r in M.cluster_hot_symbols(g).orderBy("cluster", "rank").collect():
        names.setdefault(r.cluster, []).append(r.qualified_name)
    out += ["", "## Clusters", ""]
    for r in M.clusters(g).orderBy(F.desc("degree"), "cluster").limit(top).collect():
        out.append(f"- {r.cluster} ({r.files} files, {r.symbols} symbols): {', '.join(names.get(r.cluster, []))}")
    out += ["", "## Entry points", ""]
    out += [f"- {r.id} ({r.score})" for r in M.entries(g, limit=top).orderBy(F.desc("score"), "id").collect()]
    return within("\n".join(out) + "\n", budget)


def report(g: SymbolGraph, top: int = 20) -> str:
    """Markdown: health, quality, oversized modules, dead code, files by use."""
    h, q = H.health(g).first(), M.quality(g).first()
    out = ["# Report", "", f"- health: {h.score} ({h.label}): {h.cycles} cycles, {h.god_modules} oversized modules, {h.dead_public} unused public symbols, {h.warnings} warnings", f"- edges: {q.score} ({q.label}), {q.uncertain_edges} uncertain", "", "## Oversized modules", ""]
    out += [f"- `{r.module}`: {r.symbols} symbols, {r.lines} lines" for r in H.god_modules(g).orderBy(F.desc(F.col("symbols") + F.col("lines")), "module").limit(top).collect()]
    out += ["", "## Unused public symbols", ""]
    out += [f"- `{r.id}`" for r in H.dead_public(g).orderBy("id").limit(top).collect()]
    out += ["", "## Files by use", ""]
    out += [f"- `{r.file}`: {r.fan_in} in, {r.fan_out} out" for r in H.fanout(g).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "file").limit(top).collect()]
    return "\n".join(out) + "\n"
