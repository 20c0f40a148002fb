"""Orders in which to change symbols: dependencies first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SymbolGraph
from ..runtime import numbered_rows, saved, stored
from .impact import risks
from .lookup import find_nodes
from .traverse import HELD as BROADCAST
from .traverse import Steps

#: Up to this many pairs are peeled in one task, in 4 bytes a pair and 20 a node; beyond, by joins, level by level.
HELD = 500_000_000
#: So many users of a level's nodes are looked at in one array operation.
SLICE = 1 << 22


def _peel(batches: Iterable[pa.RecordBatch], nodes: int, pairs: int) -> Iterator[pa.RecordBatch]:
    """(n, level) of ``pairs`` rows (t, f) over nodes 0 to ``nodes``: each level is array operations over the users of the one before.

    Rows of one t may come in several runs; users are kept as they come, and of each node where its first run is.
    """
    users = np.empty(pairs, np.int32)
    first, size, left = np.zeros(nodes, np.int64), np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
    more: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for b in batches:
        if not b.num_rows:
            continue
        t, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        users[at : at + len(f)] = f
        np.add.at(left, f, 1)
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        run = np.diff(np.append(start, len(t)))
        who, which = np.unique(t[start], return_index=True)
        new = which[size[who] == 0]
        first[t[start[new]]], size[t[start[new]]] = at + start[new], run[new]
        again = np.ones(len(start), bool)
        again[new] = False
        for i in np.flatnonzero(again):
            more.setdefault(int(t[start[i]]), []).append((at + int(start[i]), int(run[i])))
        at += len(f)
    if not at:
        return
    split = np.zeros(nodes, bool)
    split[list(more)] = True
    level = np.full(nodes, -1, np.int32)
    now, number = np.flatnonzero(left == 0), 0
    while len(now):
        level[now] = number
        begin, length = first[now], size[now].astype(np.int64)
        if more and len(extra := [r for n in now[split[now]] for r in more[int(n)]]):
            begin, length = (np.concatenate([x, y]) for x, y in zip((begin, length), np.array(extra, np.int64).T))
        free, upto, low = [], np.cumsum(length), 0
        while low < len(length):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SLICE, "right")))
            n = length[low:high]
            who = users[np.arange(n.sum()) + np.repeat(begin[low:high] - (np.cumsum(n) - n), n)]
            np.subtract.at(left, who, 1)
            free.append(who[left[who] == 0])
            low = high
        now, number = np.unique(np.concatenate(free)), number + 1
    done = np.flatnonzero(level >= 0)
    for i in range(0, len(done), SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(done[i : i + SLICE]), pa.array(level[done[i : i + SLICE]])], ["n", "level"])


def _peeled(pairs: DataFrame, count: int) -> DataFrame:
    """(id, level) of so many distinct pairs, peeled in one task over the numbers of their nodes."""
    ids = numbered_rows(pairs.select(F.explode(F.array("f", "t")).alias("id")).distinct(), "n")
    by_f = pairs.join(ids.select(F.col("id").alias("f"), F.col("n").cast("int").alias("nf")), "f").select("t", "nf")
    both = by_f.join(ids.select(F.col("id").alias("t"), F.col("n").cast("int").alias("nt")), "t").select("nt", "nf")
    placed = stored(both.sortWithinPartitions("nt"))
    nodes = ids.count()
    levels = placed.coalesce(1).mapInArrow(lambda batches: _peel(batches, nodes, count), "n bigint, level int")
    return ids.join(levels, "n").select(F.col("id").cast("string").alias("id"), "level")


def topo_levels(pairs: DataFrame, held: int = HELD) -> DataFrame:
    """(id, level) of (f, t) pairs, f needing t: 0 needs nothing, others come after all they need.

    Nodes on or behind a cycle have no level and are left out; so are null ends
    and pairs of equals.  Up to ``held`` pairs are peeled in one task, which
    holds numbers only; numbers are given, and pairs put in order, by all tasks.
    Of more, each pass counts down what the nodes still need; the pairs stay
    where they are, and passes are as many as the longest chain, however long.
    """
    whole = all(kind in ("int", "bigint") for _, kind in pairs.select("f", "t").dtypes)
    kind = "bigint" if whole else "string"
    rest = stored(pairs.select(F.col("f").cast(kind).alias("f"), F.col("t").cast(kind).alias("t")).where("f != t").distinct())
    count = rest.count()
    if count <= held:
        return _peeled(rest, count)
    rest = rest.select(F.col("f").cast("string").alias("f"), F.col("t").cast("string").alias("t"))
    needs = rest.select(F.explode(F.array(F.struct(F.col("f").alias("id"), F.lit(1).alias("n")), F.struct(F.col("t").alias("id"), F.lit(0).alias("n")))).alias("e")).groupBy("e.id").agg(F.sum("e.n").alias("left"))
    nodes = saved(needs.withColumn("level", F.when(F.col("left") == 0, 0)))
    steps = Steps(rest.select(F.col("t").alias("node"), F.col("f").alias("next")), BROADCAST)
    level = 0
    while size := nodes.where(F.col("level") == level).count():
        now = nodes.where(F.col("level") == level).select(F.col("id").alias("parent"))
        less = steps.meet(now, size).groupBy(F.col("next").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        left = F.col("left") - F.coalesce("n", F.lit(0))
        level += 1
        nodes = saved(nodes.join(less, "id", "left").select("id", left.alias("left"), F.when(F.col("level").isNull() & (left == 0), level).otherwise(F.col("level")).alias("level")))
    steps.release()
    return nodes.where("level is not null").select("id", "level")


def kahn(needs: dict[str, set[str]]) -> list[str]:
    """Dependencies first; free nodes in order of name, then as they come free."""
    waiting = {n: set(d) & set(needs) - {n} for n, d in needs.items()}
    users: dict[str, list[str]] = {n: [] for n in needs}
    for n in sorted(needs):
        for d in waiting[n]:
            users[d].append(n)
    queue, out = sorted(n for n, d in waiting.items() if not d), []
    while queue:
        n = queue.pop(0)
        out.append(n)
        for u in users[n]:
            waiting[u].discard(n)
            if not waiting[u]:
                queue.append(u)
    return out


def components(needs: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected sets of two or more, or one that needs itself; without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out = []
    for root in sorted(needs):
        if root in index:
            continue
        work = [(root, iter(sorted(needs.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            n, successors = work[-1]
            for s in successors:
                if s not in needs:
                    continue
                if s not in index:
                    index[s] = low[s] = len(index)
                    stack.append(s)
                    on.add(s)
                    work.append((s, iter(sorted(needs[s]))))
                    break
                if s in on:
                    low[n] = min(low[n], index[s])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == n:
                            break
                    if len(part) > 1 or n in needs[n]:
                        out.append(sorted(part))
    return out


def refactor_order(g: SymbolGraph, names: list[str], depth: int = 2) -> tuple[DataFrame, list[list[str]], list[str]]:
    """((step, id, score, level), cycles, unresolved names) for a set of symbols to change."""
    chosen, missing = {}, []
    for name in names:
        rows = find_nodes(g, name).select("id", "kind").collect()
        if not rows:
            missing.append(name)
            continue
        chosen[next((r.id for r in rows if r.kind in ("function", "method", "constructor")), rows[0].id)] = name
    spark = g.nodes.sparkSession
    ids = list(chosen)
    inside = g.edges.where(F.col("kind").isin("calls", "uses_type", "returns", "imports") & F.col("src").isin(ids) & F.col("dst").isin(ids)).select("src", "dst").collect()
    needs: dict[str, set[str]] = {i: set() for i in ids}
    for r in inside:
        needs[r.src].add(r.dst)
    order = kahn(needs)
    rest = {n: d for n, d in needs.items() if n not in order}
    risk = {r.id: r for r in risks(g, ids, depth).collect()} if ids else {}
    steps = [(step, node, int(risk[node].score), risk[node].level) for step, node in enumerate([*order, *sorted(rest)], 1)]
    return spark.createDataFrame(steps, "step int, id string, score int, level string"), components(rest), missing
