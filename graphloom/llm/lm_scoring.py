"""Language-model scores by a weighted backoff automaton over bytes.

Counts of all byte n-grams up to order 5 are taken over the whole corpus.  Each
context that is seen becomes a state; an n-gram becomes an arc from its context,
weighted with the logarithm of its smoothed probability; every state has a
failure arc to the context without its first byte, weighted with the logarithm
of the mass that smoothing sets aside.  A text is scored in one traversal from
left to right: take the byte's arc if the state has one, else add the failure
weight, fall back, and try again.

Smoothing is interpolated absolute discounting: of an n-gram seen n times after
a context seen N times, p = (n - D) / N + left(context) p(shorter context), and
left(context) is what the discounts and the pruned n-grams leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import ID

ORDER = 5
DISCOUNT = 0.75
#: An n-gram stays if it is seen this often, whatever the size of the corpus: states grow with it, and rare n-grams count.
LEAST = 1
#: A share of all bytes below which n-grams are pruned too; none unless a caller asks for it.
KEEP = 0.0
#: Bytes of a lane: texts are traversed side by side in pieces, each entered with the state its place has.
LANE = 1024
#: n-grams that a task holds before it merges equal ones.
_HELD = 1 << 22


def padded(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents lo..hi, each after ``pad`` zero bytes: (bytes, start of each document's pad + end, its length)."""
    size = np.diff(offs[lo : hi + 1])
    start = np.r_[0, np.cumsum(size + pad)]
    out = np.zeros(start[-1], dtype=np.uint8)
    body = np.ones(start[-1], dtype=bool)
    body[(start[:-1, None] + np.arange(pad)).ravel()] = False
    out[body] = data[offs[lo] : offs[hi]]
    return out, start, size


def grams(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, order: int) -> np.ndarray:
    """The n-gram of ``order`` bytes that ends at each byte, as one integer; zero bytes stand before a text."""
    b, start, _ = padded(data, offs, lo, hi, order - 1)
    at = np.ones(len(b), dtype=bool)
    at[(start[:-1, None] + np.arange(order - 1)).ravel()] = False
    code = np.zeros(len(b), dtype=np.int64)
    for k in range(order):
        code[k:] |= b[: len(b) - k].astype(np.int64) << (8 * k)
    return code[at]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _tally(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            data, offs = v.buffers(batch.column(0))
            for lo, hi in v.chunks(offs):
                code = np.sort(grams(data, offs, lo, hi, order))
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
                parts.append((code[first], np.diff(np.r_[first, len(code)])))
                held += len(first)
                if held > _HELD:
                    parts = [_merge(parts)]
                    # a second batch joins the merged one; if little merged, let more come in first
                    held = len(parts[0][0]) // 2
        if parts:
            codes, n = _merge(parts)
            for i in range(0, len(codes), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)].astype(np.int64))], ["code", "n"])

    return run


def count_grams(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(code, n): how often each run of ``order`` bytes occurs in all texts; counted in the tasks, summed by shuffle."""
    source = docs.select(docs[text_col].cast("string").alias("t")).where("t is not null")
    return source.mapInArrow(_tally(order), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Automaton:
    """Arcs in an open-addressing table by state and byte; failure arcs by state.  State 0 is the empty context."""

    order: int
    slots: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    #: The state before a text.
    start: int = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (v.mix(key.astype(v.U64)) & v.U64(len(self.slots) - 1)).astype(np.int64)

    def find(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Place of each arc in the table, -1 where there is none."""
        key = state.astype(np.int64) << 8 | byte
        at = self._slot(key)
        got = self.slots[at]
        out = np.where(got == key, at, -1)
        rest = np.flatnonzero((got != key) & (got >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            got = self.slots[at[rest]]
            hit = got == key[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (got >= 0)]
        return out

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of the byte, next state) for each lane."""
        logp = np.zeros(len(state))
        arc = self.find(state, byte)
        rest = np.flatnonzero(arc < 0)
        back = state
        if len(rest):
            back = state.copy()
        while len(rest):
            logp[rest] += self.fail_weight[back[rest]]
            back[rest] = self.fail[back[rest]]
            arc[rest] = self.find(back[rest], byte[rest])
            rest = rest[arc[rest] < 0]
        return logp + self.weight[arc], self.target[arc]

    def score(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Log-probability of each text."""
        pad = self.order - 1
        b, start, size = padded(data, offs, lo, hi, pad)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(hi - lo), lanes)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(LANE, size[doc] - piece * LANE)
        # the longest lanes first: those still running are then a prefix
        order = np.argsort(-length, kind="stable")
        at, length = (start[doc] + piece * LANE)[order], length[order]
        state, total = np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
        # a state is the longest known context among the last bytes, so these alone lead to it
        for k in range(pad):
            _, state = self.step(state, b[at + k].astype(np.int64))
        state[piece[order] == 0] = self.start
        running = np.searchsorted(-length, -np.arange(LANE), "left")
        for k in range(int(length.max(initial=0))):
            n = running[k]
            logp, state[:n] = self.step(state[:n], b[at[:n] + pad + k].astype(np.int64))
            total[:n] += logp
        out = np.zeros(hi - lo)
        np.add.at(out, doc[order], total)
        return out


def build(counts: dict[int, tuple[np.ndarray, np.ndarray]], totals: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER, discount: float = DISCOUNT) -> Automaton:
    """From order -> (n-grams, counts) and order -> (contexts, counts of what follows them), both sorted."""
    # contexts of length k are states: a context stays if an n-gram of it does
    contexts = {0: np.zeros(1, dtype=np.int64)} | {k: np.unique(counts[k + 1][0] >> 8) for k in range(1, order)}
    base = np.cumsum([0, *(len(contexts[k]) for k in range(order))])
    n_states = int(base[-1])
    fail, left = np.zeros(n_states, dtype=np.int64), np.ones(n_states)

    def place(k: int, code: np.ndarray) -> np.ndarray:
        """State of each context of length k, -1 where it is none."""
        known = contexts[k]
        if not len(known):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[at] == code, at + base[k], -1)

    keys, weights, targets = [], [], []
    shorter_codes, shorter_p = None, None
    for k in range(1, order + 1):
        codes, n = counts[k]
        state = place(k - 1, codes >> 8)
        seen = totals[k][1][np.searchsorted(totals[k][0], codes >> 8)] if len(codes) else n
        share = (n - discount) / seen
        np.subtract.at(left, state, share)
        if k == 1:
            p = share + left[0] / 256
            every = np.arange(256)
            full = np.full(256, left[0] / 256)
            full[codes] = p
            codes, p, state = every, full, np.zeros(256, dtype=np.int64)
        else:
            tail = codes & ((1 << 8 * (k - 1)) - 1)
            p = share + left[state] * shorter_p[np.searchsorted(shorter_codes, tail)]
            if k > 2:
                own = contexts[k - 1]
                fail[base[k - 1] : base[k]] = place(k - 2, own & ((1 << 8 * (k - 2)) - 1))
        # an arc leads to the longest known context that ends in its byte
        target = np.full(len(codes), -1)
        for length in range(min(k, order - 1), -1, -1):
            open_ = target < 0
            target[open_] = place(length, codes[open_] & ((1 << 8 * length) - 1))
        keys.append(state << 8 | (codes & 255))
        weights.append(np.log(p))
        targets.append(target)
        shorter_codes, shorter_p = codes, p
    key, weight, target = map(np.concatenate, (keys, weights, targets))
    size = 1 << max(10, int(4 * len(key) - 1).bit_length() - 1)
    a = Automaton(order, np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.float64), np.zeros(size, dtype=np.int64), fail, np.log(np.maximum(left, 1e-300)))
    at, todo = a._slot(key), np.arange(len(key))
    while len(todo):
        free = todo[a.slots[at[todo]] < 0]
        # of several for one place the last written stays
        a.slots[at[free]] = key[free]
        won = free[a.slots[at[free]] == key[free]]
        a.weight[at[won]], a.target[at[won]] = weight[won], target[won]
        todo = todo[a.slots[at[todo]] != key[todo]]
        at[todo] = (at[todo] + 1) & (size - 1)
    zeros = [int(s[0]) for k in range(order) if (s := place(k, np.zeros(1, dtype=np.int64)))[0] >= 0]
    a.start = zeros[-1]
    return a


def train(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, keep: float = KEEP, text_col: str = "text") -> Automaton:
    """The automaton of a corpus.  Texts that are null or empty add nothing; of no text at all every byte has probability 1/256."""
    from ._rows import saved

    top = saved(count_grams(docs, order, text_col))
    total = top.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, int(np.ceil(total * keep)))
    every = top.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("code").bitwiseAND((1 << 8 * k) - 1)).alias("code")) for k in range(1, order + 1)))).alias("g"), "n").select("g.k", "g.code", "n")
    found = every.groupBy("k", "code").agg(F.sum("n").alias("n"))
    # a context is as frequent as any n-gram of it, so the same bound keeps all that are needed
    follows = every.groupBy("k", F.shiftright("code", 8).alias("code")).agg(F.sum("n").alias("n"))

    def tables(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        t = df.where(F.col("n") >= least).toArrow()
        k, code, n = (t.column(c).to_numpy() for c in ("k", "code", "n"))
        out = {}
        for o in range(1, order + 1):
            mine = k == o
            at = np.argsort(code[mine])
            out[o] = (code[mine][at], n[mine][at])
        return out

    return build(tables(found), tables(follows), order, discount)


def score(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log_prob, bits_per_byte) of every row, in one pass without a shuffle.

    log_prob is the natural logarithm of the whole text's probability.  A null
    or empty text has 0 bytes, log_prob 0 and null bits.  A NUL byte in a text
    counts as the mark before its start.  Texts have any length and are
    traversed whole, in lanes.  Repeated rows each give a row, null ids stay,
    extra columns are ignored whatever their names, no rows give no rows.
    """
    source = docs.select(docs[id_col].alias(ID), docs[text_col].cast("string"))
    kind = source.schema[ID].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            data, offs = v.buffers(batch.column(1))
            for lo, hi in v.chunks(offs, 16 * v.CHUNK_BYTES):
                size = np.diff(offs[lo : hi + 1])
                logp = a.score(data, offs, lo, hi)
                bits = pa.array(-logp / np.maximum(size, 1) / np.log(2), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(logp), bits], [ID, "n_bytes", "log_prob", "bits_per_byte"])

    return source.mapInArrow(run, f"{ID} {kind}, n_bytes bigint, log_prob double, bits_per_byte double").withColumnRenamed(ID, "doc_id")


def lm_scores(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of a corpus by its own model; see :func:`train` and :func:`score`."""
    return score(docs, train(docs, order, discount, keep, text_col), id_col, text_col)
