"""Periodic runs of words, found on a grammar.

A run is a maximal stretch of consecutive words with smallest period ``q`` that holds at least four periods (and six words). The
word ids of every document are compressed by Re-Pair: in a round, the repeated pairs that touch no more frequent pair become
nonterminals, for all documents of a batch at once; what is left of a document is paired up to one root. The lowest nonterminal
that holds a run has it across its boundary, so every nonterminal is searched once, at its first occurrence: a run of four periods
leaves two of them on one side of the boundary, where two neighbouring blocks of ``q`` words must be equal. What is found is carried
to all other places of the nonterminal, and intervals of one period that overlap by it are merged to the maximal one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: A run holds at least so many periods, and so many words.
PERIODS, SHORTEST = 4, 6
#: Words of whole documents that one grammar pass takes at once, and candidates (boundary, period) tested at once.
WORDS_AT_ONCE, TESTED_AT_ONCE = 1 << 17, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Word -> number, in order of first appearance."""

    def __init__(self):
        self.next = count()

    def __missing__(self, word) -> int:
        self[word] = n = next(self.next)
        return n


def _repair(symbols: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of Re-Pair over the sequences of several documents, then of plain pairing up to one root each.

    Yields (rule, lo, m, hi): every occurrence of the round's nonterminals as places of the text, sorted by rule.
    """
    bound = np.r_[start, start[-1] + 1]  # a symbol's end is the next one's start: the documents stand side by side
    # ids are told apart by document, so that a pair counts within its own one
    symbols = np.unique(doc * (symbols.max() + 1) + symbols, return_inverse=True)[1]
    repeats = True
    while True:
        inner = doc[:-1] == doc[1:]
        if not inner.any():
            return
        if repeats:
            often = np.bincount(symbols)[symbols] > 1
            at = np.flatnonzero(inner & often[:-1] & often[1:])
            # of overlapping pairs of one symbol every second one
            same = symbols[at] == symbols[at + 1]
            if same.any():
                block = np.cumsum(np.r_[True, ~(same[1:] & same[:-1] & (at[1:] == at[:-1] + 1))]) - 1
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                at = at[~same | ((np.arange(len(at)) - first[block]) % 2 == 0)]
            key = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
            values, rule, n = np.unique(key, return_inverse=True, return_counts=True)
            # the more frequent pair of two that touch goes first, of equally frequent ones the one with the larger hash
            weight = (n.astype(np.uint64) << np.uint64(32)) | ((values.astype(np.uint64) * _MIX) >> np.uint64(32))
            w = np.where(n > 1, weight, np.uint64(0))[rule]
            near = at[1:] == at[:-1] + 1
            left, right = np.r_[np.uint64(0), np.where(near, w[:-1], np.uint64(0))], np.r_[np.where(near, w[1:], np.uint64(0)), np.uint64(0)]
            chosen = (w > left) & (w >= right)
            rule, at = rule[chosen], at[chosen]
            keep = np.bincount(rule, minlength=len(values))[rule] > 1
            rule, at = np.unique(rule[keep], return_inverse=True)[1], at[keep]
            repeats = len(at) > 0
        if not repeats:
            place = np.arange(len(doc)) - np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])[np.cumsum(np.r_[0, doc[1:] != doc[:-1]])]
            at = np.flatnonzero(inner & (place[:-1] % 2 == 0))
            rule = np.arange(len(at))
        order = np.argsort(rule, kind="stable")
        yield rule[order], bound[at[order]], bound[at[order] + 1], bound[at[order] + 2]
        symbols = symbols.copy()
        symbols[at] = symbols.max() + 1 + rule
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, doc, bound = symbols[stay], doc[stay], bound[np.r_[stay, True]]


def _squares(ids: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], lo: np.ndarray, m: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, q, start), sorted: two equal blocks of q words (by their hashes) stand next to each other on one side of the node's boundary."""
    prefix, power = hashes
    most = (hi - lo) // PERIODS
    found = []
    for right in (True, False):
        counts = np.minimum(most, ((hi - m) if right else (m - lo)) // 2)
        ends = np.cumsum(counts)
        step = 0
        while step < len(counts):
            upto = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + TESTED_AT_ONCE, "right")))
            c = counts[step:upto]
            node = np.repeat(np.arange(step, upto), c)
            q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(c) - c, c)
            a = m[node] if right else m[node] - 2 * q
            ok = np.flatnonzero(ids[a] == ids[a + q])
            node, q, a = node[ok], q[ok], a[ok]
            with np.errstate(over="ignore"):
                ok = (prefix[a + q] - prefix[a]) * power[q] == prefix[a + 2 * q] - prefix[a + q]
            found.append((node[ok], q[ok], a[ok]))
            step = upto
    node, q, a = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((a, q, node))
    return node[order], q[order], a[order]


def _extent(ids: np.ndarray, lo: int, hi: int, q: int, at: int) -> tuple[int, int]:
    """The longest stretch of period q within [lo, hi) around the place ``at``."""
    def reach(i: int, stop: int, sign: int) -> int:
        size = 32
        while i != stop:
            j = min(i + size, stop) if sign > 0 else max(i - size, stop)
            a, b = (i, j) if sign > 0 else (j, i)
            unequal = np.flatnonzero(ids[a:b] != ids[a + q : b + q])
            if len(unequal):
                return a + int(unequal[0]) if sign > 0 else a + int(unequal[-1]) + 1
            i, size = j, size * 4
        return i

    return reach(at, lo, -1), reach(at, hi - q, 1) + q


def runs_of(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, sorted; ``ids`` are the words of the documents side by side."""
    if len(ids) < SHORTEST:
        return np.zeros((0, 4), np.int64)
    with np.errstate(over="ignore"):
        power = np.full(len(ids) + 1, _MIX | np.uint64(1), np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        scattered = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        prefix = np.r_[np.uint64(0), np.add.accumulate((scattered ^ (scattered >> np.uint64(29))) * power[:-1])]
    pieces = []
    for rule, lo, m, hi in _repair(ids, doc, np.arange(len(ids))):
        first = np.flatnonzero(np.r_[True, rule[1:] != rule[:-1]])
        first = first[hi[first] - lo[first] >= SHORTEST]
        if not len(first):
            continue
        crossing: dict[int, list[tuple[int, int, int]]] = {}
        for k, q, a in zip(*(x.tolist() for x in _squares(ids, (prefix, power), lo[first], m[first], hi[first]))):
            at = int(first[k])
            known = crossing.setdefault(at, [])
            if any(q % p == 0 and b <= a and a + 2 * q <= e for b, e, p in known):
                continue  # a multiple of the period of a stretch that is known
            b, e = _extent(ids, int(lo[at]), int(hi[at]), q, a)
            if e - a >= 2 * q:  # else the hashes only agreed
                known.append((b, e, q))
        for at, known in crossing.items():
            places = lo[at : int(np.searchsorted(rule, rule[at], "right"))] - lo[at]
            for b, e, q in known:
                if b < m[at] < e and e - b >= max(SHORTEST, PERIODS * q):
                    pieces.append(np.column_stack([places + b, places + e, np.full(len(places), q)]))
    if not pieces:
        return np.zeros((0, 4), np.int64)
    b, e, q = np.concatenate(pieces).T
    order = np.lexsort((-e, b, q, doc[b]))
    b, e, q, d = b[order], e[order], q[order], doc[b[order]]
    kept: list[list[int]] = []
    for x in zip(d.tolist(), b.tolist(), e.tolist(), q.tolist()):
        if kept and kept[-1][0] == x[0] and kept[-1][3] == x[3] and x[1] <= kept[-1][2] - x[3]:
            kept[-1][2] = max(kept[-1][2], x[2])
        else:
            kept.append(list(x))
    out = np.array(kept, np.int64)
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    # of the periods of one stretch only the smallest counts
    out = out[np.r_[True, (out[1:, :3] != out[:-1, :3]).any(axis=1)]]
    out[:, 2] -= out[:, 1]
    out[:, 1] -= np.searchsorted(doc, out[:, 0])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _batch(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(runs, kept words) of every document of a list of word lists."""
    ids = _Ids()
    sizes = np.array([len(t) for t in texts])
    numbers = np.fromiter((ids[w] for t in texts for w in t), np.int64, sizes.sum())
    found = runs_of(numbers, np.repeat(np.arange(len(texts)), sizes))
    upto = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for k, words in enumerate(texts):
        runs = found[upto[k] : upto[k + 1], 1:]
        if len(runs):
            keep = np.ones(len(words), bool)
            for s, n, p in runs.tolist():
                keep[s + p : s + n] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        yield runs, words


def detect(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs`` (doc_id, text).

    ``runs``: array of (start, length, period) in words from 0, by start, then period. ``collapsed``: the words that no run repeats,
    joined by one blank; of a run its first period stays. ``rewrite`` (document id, words) may change a document's words first. Words
    are split at ASCII white space. A null or empty text has no words. Repeated rows and rows without an id are treated one by one;
    columns besides the two are ignored. Documents are taken whole, in batches of bounded numbers of words; one that is longer is a batch of its own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = [], []
        for r, words in _batch(texts):
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in r.tolist()])
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.binary()).cast(pa.string())],
                                          names=["doc_id", "runs", "collapsed"])

    def run(batches):
        ids, texts, words = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, own = doc_id.as_py(), text.as_py().split()
                ids.append(doc_id)
                texts.append(rewrite(doc_id, own) if rewrite else own)
                words += len(texts[-1])
                if words >= WORDS_AT_ONCE:
                    yield flush(ids, texts)
                    ids, texts, words = [], [], 0
        if ids:
            yield flush(ids, texts)

    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repetition planted by the id: of every tenth document (by crc32) the end repeats one stretch of it."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _greatest(runs: Column) -> Column:
    """The run with the greatest length/period; of several the first by start, then period."""
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.element_at(runs, 1), lambda best, x: F.when(ahead(x, best), x).otherwise(best))


def report(docs: DataFrame) -> DataFrame:
    """Digests of ``detect`` with the planted repetitions: doc_id, n_runs, the greatest run, hashes of all runs and of the collapsed text.

    A document without runs has four nulls for the greatest one; the hashes are never null.
    """
    found = detect(docs, planted)
    best = F.when(F.size("runs") > 0, _greatest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
