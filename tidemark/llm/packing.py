"""Sequence packing by patterns of few lengths, fitted to the length histogram with non-negative least squares.

Everything that is decided centrally depends on the histogram of piece lengths only, which has at most ``capacity`` entries at any
corpus size. Lengths are grouped into classes; every multiset of up to three classes that fills a sequence is a pattern; NNLS gives
the repeat count of each pattern. A pattern is then realised with real lengths, as runs of equal combinations: the last member of a
combination is the longest length that still fits, so rounding to classes costs nothing. What the rounded counts leave over is packed
best-fit, longest first, again in runs of equal length. The outcome is a table of rank intervals per length - a piece
needs only its length and its rank among the pieces of that length to know its sequence and its offset.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, slices
from tidemark.session import cut_lineage

CAPACITY = 2048
END_ID = 0
#: Width of a length class, in parts of a sequence, and most members of a pattern.
CLASSES = 128
DEPTH = 3
#: Most tokens that a realised pattern may leave free; what would leave more is left to the residual packing.
SLACK = 0
#: Texts of these characters only are split alike by both tokenizer libraries; others go the slower way.
_PLAIN = re.compile(r"[\n\r\t -~¡-¬®-ɏ]*")


@cache
def _encoders(vocabulary: str, ranks: str, special: str):
    """The tokenizer, and a faster one with the same vocabulary for plain texts."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return full, fast


def token_ids(text: str, vocabulary: str, ranks: str, special: str = "<|endoftext|>") -> np.ndarray:
    """Ids of a text as the tokenizer of the file ``vocabulary`` gives them, without added tokens."""
    full, fast = _encoders(vocabulary, ranks, special)
    if special not in text and _PLAIN.fullmatch(text):
        return np.array(fast.encode_ordinary(text), "<u4")
    return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): token pieces, ranked within their task's pieces of the same length.

    Every document gets an end token, so a null or empty text is one piece of one token. Only a document longer than ``capacity`` is
    cut, into full pieces after a first one that takes the remainder.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        part_id = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = np.append(token_ids(text, vocabulary, ranks), np.array([END_ID], "<u4")).astype("<u4")
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part_id, int(used[b - a])))
                    used[b - a] += 1
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every non-increasing tuple of up to ``depth`` class numbers (1..classes) that sums to ``classes``."""
    out = []

    def grow(rest: int, largest: int, chosen: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(chosen)
        elif len(chosen) < depth:
            for c in range(min(rest, largest), 0, -1):
                if c * (depth - len(chosen)) >= rest:
                    grow(rest - c, c, (*chosen, c))

    grow(classes, classes, ())
    return out


def nnls(gram: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises x'Gx/2 - t'x, by the active-set method; a solution has no more positives than the system has rank."""
    n = len(target)
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(target).max())
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= tolerance:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            new = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=1e-12)[0]
            low = new <= 0
            if not low.any():
                x[:] = 0
                x[at] = new
                break
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - new[low], 1e-300))
            moved = old + step * (new - old)
            moved[low & (moved <= tolerance)] = 0
            moved[low & (np.arange(len(at)) == np.flatnonzero(low)[np.argmin(old[low] / np.maximum(old[low] - new[low], 1e-300))])] = 0
            x[at] = np.maximum(moved, 0)
            active[at[x[at] == 0]] = False
    return x


class _Plan:
    """Counts by length that are still to be placed, and the intervals placed so far."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.capacity, self.total = capacity, histogram.astype(np.int64)
        self.left = self.total.copy()
        self.lengths = [int(x) for x in np.flatnonzero(self.left)]  # those that have pieces left, ascending
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # free room -> [(first sequence, how many)]
        self.rooms: list[int] = []
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.total[length] - self.left[length]), count, sequence, offset))
        self.left[length] -= count
        if not self.left[length]:
            self.lengths.remove(length)

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((sequence, count))

    def longest(self, room: int, low: int = 1) -> int:
        k = bisect_right(self.lengths, room)
        return self.lengths[k - 1] if k and self.lengths[k - 1] >= low else 0

    def realise(self, pattern: tuple[int, ...], count: int, width: int) -> None:
        """``count`` sequences after a pattern, as far as its classes have pieces: runs of equal lengths, longest first."""
        while count > 0:
            chosen: list[int] = []
            room, need = self.capacity, {}
            for k, c in enumerate(pattern):
                top = room if k == len(pattern) - 1 else min(room, c * width)
                low = max(1, (c - 1) * width + 1 - (width if k == len(pattern) - 1 else 0))
                length = top
                while (length := self.longest(length, low)) and self.left[length] <= need.get(length, 0):
                    length -= 1
                if not length:
                    return
                need[length] = need.get(length, 0) + 1
                chosen.append(length)
                room -= length
            if room > SLACK:
                return
            times = min([count, *(int(self.left[x]) // n for x, n in need.items())])
            offset = 0
            for length in chosen:
                self.take(length, times, self.sequences, offset)
                offset += length
            self.leave(self.capacity - offset, self.sequences, times)
            self.sequences += times
            count -= times

    def best_fit(self) -> None:
        while self.lengths:
            length = self.lengths[-1]
            at = bisect_right(self.rooms, length - 1)
            if at == len(self.rooms):
                times = -(-int(self.left[length]) // (self.capacity // length))
                self.leave(self.capacity, self.sequences, times)
                self.sequences += times
                continue
            room = self.rooms[at]
            stock = self.open[room]
            sequence, count = stock.pop()
            times = min(count, int(self.left[length]))
            if times < count:
                stock.append((sequence + times, count - times))
            if not stock:
                del self.open[room]
                self.rooms.pop(at)
            self.take(length, times, sequence, self.capacity - room)
            self.leave(room - length, sequence, times)


def plan(histogram: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset), sorted, and the number of sequences, for counts by length (0..capacity)."""
    p = _Plan(histogram, capacity)
    if p.left[capacity]:
        n = int(p.left[capacity])
        p.take(capacity, n, 0, 0)
        p.sequences = n
    width = capacity // classes
    if width >= 1 and p.left.any():
        shapes = [s for s in patterns(classes, depth) if len(s) > 1]
        of = -(-np.arange(capacity + 1) // width)
        have = np.bincount(of, weights=p.left, minlength=classes + 1)[1:]
        matrix = np.zeros((classes, len(shapes)))
        for j, s in enumerate(shapes):
            for c in s:
                matrix[c - 1, j] += 1
        # short pieces fill gaps anyway, so missing them costs little
        weight = np.sqrt(np.arange(1, classes + 1) / classes)[:, None]
        scaled = matrix * weight
        repeats = nnls(scaled.T @ scaled, scaled.T @ (weight[:, 0] * have))
        for j in sorted(np.flatnonzero(repeats >= 1), key=lambda j: [-c for c in shapes[j]]):
            p.realise(shapes[j], int(repeats[j]), width)
    p.best_fit()
    rows = np.array(sorted(p.rows), np.int64).reshape(-1, 5)
    return rows, p.sequences


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (see ``pieces``) with ``sequence_id`` and ``offset``: gapless from 0 in every sequence, no more than ``capacity`` in all.

    The driver sees one row per length. Ranks become global by adding, for every task, what earlier tasks have of the length; no
    length is gathered anywhere, however frequent it is. No rows: no rows.
    """
    spark = parts.sparkSession
    parts = cut_lineage(parts)
    counts = cut_lineage(parts.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    rows, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = parts.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank")
    keys = (rows[:, 0] << 48) + rows[:, 1]
    shared = spark.sparkContext.broadcast((keys, rows))

    def place(batches):
        keys, rows = shared.value
        for part in batches:
            length, rank = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sequence), pa.array(rows[at, 4])],
                                             names=[*part.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
