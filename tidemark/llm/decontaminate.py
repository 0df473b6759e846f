"""Benchmark decontamination: rare n-gram seeds find the passages, Smith-Waterman alignment scores them.

The test items are the stated query set: they are read in blocks of bounded size, and every block meets every document in two
narrow scans without a shuffle of text. The first counts in how many documents each n-gram of an item occurs; the second looks
for the seeds and aligns the surroundings of every hit with the item, word by word. Seeds are the n-grams that few documents have by the
item's own measure - up to ``RARE`` times the lower quartile of its counts -, those that few different items have, and the rarer one of
any two that follow each other. The last two don't depend on how often an item leaked: edited copies make the n-grams that they hold
frequent and leave those that they break rare, and must be found by the former. A stock phrase starts few alignments, since the words that
a place has in common with the item bound its score, and only where the bound suffices it is aligned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, slices

SEED_WORDS = 3
RARE = 8
#: An n-gram that at most so many different items have is a seed however many documents have it.
FEW_ITEMS = 4
#: Items with fewer words identify nothing and never match.
MIN_ITEM_WORDS = 5
#: Alignment score over the score of a perfect copy, from which a passage counts as a leak of the item.
MIN_SCORE = 0.5
#: Code points of items per block: bounds what the driver and the workers hold.
BLOCK_CHARS = 8_000_000
MATCH, MISMATCH, GAP = 2, 1, 1
_WORD = re.compile(r"[^\W_]+")
#: Everything in ASCII that is no letter or digit becomes a blank.
_BLANKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, start, end) with start/end in the window (end exclusive). Linear gaps.

    Scores sit in the upper half of a number and the start of the alignment in the lower one, so one maximum carries both.
    """
    n = len(window)
    at = np.arange(n, dtype=np.int64)
    one = np.int64(1) << np.int64(32)
    slope = at * (GAP * one)
    row = np.zeros(n, np.int64)
    best, best_end = np.int64(0), 0
    for word in item:
        diagonal = np.empty(n, np.int64)
        diagonal[0], diagonal[1:] = 0, row[:-1]
        diagonal = np.where(diagonal < one, at, diagonal) + np.where(window == word, MATCH * one, -MISMATCH * one)
        row = np.maximum(np.maximum(diagonal, row - GAP * one), 0)
        row = np.maximum.accumulate(row + slope) - slope
        row[row < one] = 0
        k = int(row.argmax())
        if row[k] >> 32 > best >> 32:
            best, best_end = row[k], k + 1
    return int(best >> 32), int(best & (one - 1)), best_end


class _Letters(dict):
    """Whether a character beyond ASCII is a letter or digit."""

    def __missing__(self, c: str) -> bool:
        self[c] = known = c.isascii() or c.isalnum()
        return known


_LETTERS = _Letters()


def words_of(text: str) -> list[bytes]:
    """The runs of letters and digits of a lower-cased text.

    A text whose characters beyond ASCII are all letters or digits can be cut as bytes; others are searched for words.
    """
    if text.isascii() or all(map(_LETTERS.__getitem__, set(text))):
        return text.encode().translate(_BLANKS).split()
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text)]


@dataclass
class Block:
    """A block of items as word numbers; word 0 is any word that no item has."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, np.ndarray]]
    codes: np.ndarray  # of every n-gram of every item, sorted by item
    owner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        items, codes, owner, place = [], [], [], []
        for item_id, text in rows:
            words = words_of((text or "").lower())
            if len(words) < MIN_ITEM_WORDS:
                continue
            numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
            grams = ngrams(numbers)
            codes.append(grams)
            owner.append(np.full(len(grams), len(items)))
            place.append(np.arange(len(grams)))
            items.append((item_id, numbers))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return cls(vocabulary, items, join(codes, np.uint64), join(owner, np.int64), join(place, np.int64))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def rare(self, documents: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, owner, place) of the seeds, sorted by code: per item the n-grams that are rare for it.

        Whatever the counts, any two n-grams in a row have a seed among them, so that a copy with ``SEED_WORDS + 1`` words in a row is found.
        """
        df = np.array([documents.get(int(c.view(np.int64)), 0) for c in self.codes], np.int64)
        different: dict[bytes, int] = {}  # equal items count as one
        same = np.array([different.setdefault(x.tobytes(), k) for k, (_, x) in enumerate(self.items)], np.int64)
        _, code = np.unique(self.codes, return_inverse=True)
        pairs = np.unique(np.stack([code, same[self.owner]], axis=1), axis=0)
        keep = np.bincount(pairs[:, 0])[code] <= FEW_ITEMS
        bounds = np.searchsorted(self.owner, np.arange(len(self.items) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            mine = df[a:b]
            if not len(mine):
                continue
            keep[a:b] |= mine <= RARE * (1 + np.quantile(mine, 0.25))
            keep[a : b - 1] |= mine[:-1] <= mine[1:]
            keep[a + 1 : b] |= mine[1:] <= mine[:-1]
        order = np.argsort(self.codes[keep], kind="stable")
        return self.codes[keep][order], self.owner[keep][order], self.place[keep][order]


def ngrams(numbers: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """Hash of every n-gram; 0 where it holds a word that no item has."""
    if len(numbers) < n:
        return np.zeros(0, np.uint64)
    size = len(numbers) - n + 1
    code, known = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in range(n):
        part = numbers[k : k + size]
        code = (code ^ part.astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
        known &= part > 0
    return np.where(known, code | np.uint64(1), np.uint64(0))


def _present(codes: np.ndarray, sorted_codes: np.ndarray) -> np.ndarray:
    """Positions of ``codes`` that are among the sorted ones."""
    some = np.flatnonzero(codes)
    if not len(some) or not len(sorted_codes):
        return some[:0]
    at = np.searchsorted(sorted_codes, codes[some])
    at[at == len(sorted_codes)] = 0
    return some[sorted_codes[at] == codes[some]]


def _shared(item: np.ndarray, window: np.ndarray) -> int:
    """Most words of the item that an alignment can match in the window."""
    return int(np.isin(item, window, kind="sort").sum())


def find(block: Block, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], text: str, min_score: float = MIN_SCORE) -> list[tuple]:
    """(item_id, score, start, end) of the places of a text that copy an item; offsets are code points."""
    words = words_of(text.lower())
    numbers = block.numbers(words)
    grams = ngrams(numbers)
    codes, owner, place = seeds
    hits = _present(grams, codes)
    if not len(hits):
        return []
    first, last = np.searchsorted(codes, grams[hits], "left"), np.searchsorted(codes, grams[hits], "right")
    counts = last - first
    which = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    item, start = owner[which], np.repeat(hits, counts) - place[which]
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    out, offsets = [], None
    size = np.array([len(x) for _, x in block.items])[item]
    new = np.r_[True, (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:] // 2)]
    bounds = np.r_[np.flatnonzero(new), len(item)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        item_id, own = block.items[item[a]]
        slack = max(8, len(own) // 2)
        low, high = max(0, int(start[a]) - slack), min(len(words), int(start[b - 1]) + len(own) + slack)
        if MATCH * _shared(own, numbers[low:high]) < min_score * MATCH * len(own):
            continue
        score, x, y = align(own, numbers[low:high])
        if score >= min_score * MATCH * len(own):
            if offsets is None:
                offsets = [m.span() for m in _WORD.finditer(text.lower())]
                if len(text.lower()) != len(text):  # lower-casing may lengthen a text; then words are located in the original
                    offsets = [m.span() for m in _WORD.finditer(text)]
            from_, to = min(low + x, len(offsets) - 1), min(low + y - 1, len(offsets) - 1)
            out.append((item_id, score / (MATCH * len(own)), offsets[from_][0], offsets[to][1]))
    return out


def _blocks(docs: DataFrame, items: DataFrame):
    """Yields (block, seeds) with the frequencies counted over all of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        block = Block.of(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        if not block.items:
            continue
        shared = spark.sparkContext.broadcast((block, np.unique(block.codes)))

        def count(batches, shared=shared):
            block, known = shared.value
            totals = np.zeros(len(known), np.int64)
            for part in slices(batches):
                for text in part.column(0).to_pylist():
                    grams = ngrams(block.numbers(words_of(text.lower())))
                    totals[np.searchsorted(known, np.unique(grams[_present(grams, known)]))] += 1
            some = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(totals[some])], names=["code", "n"])

        # no more rows come back than the block has n-grams
        df = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        yield block, block.rare({r[0]: r[1] for r in df.collect()})


def leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, span_start, span_end): one row per place of a document that copies a benchmark item.

    ``score`` is the alignment score over that of a perfect copy (0 to 1); spans are code points of the original text. Words are
    lower-cased runs of letters and digits. Null or empty texts and items of fewer than five words match nothing; repeated
    documents and repeated items give repeated rows. Empty tables: no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, score double, span_start int, span_end int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block, seeds in _blocks(docs, items):
        shared = docs.sparkSession.sparkContext.broadcast((block, seeds))

        def scan(batches, shared=shared):
            block, seeds = shared.value
            for part in slices(batches):
                rows = [(d, *hit) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for hit in find(block, seeds, t, min_score)]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "span_start", "span_end"])

        out = out.union(docs.mapInArrow(scan, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others, as they are) whose text copies no item."""
    plain = id_and_text(docs)
    text_at = docs.columns.index("text")
    for block, seeds in _blocks(plain, items):
        shared = docs.sparkSession.sparkContext.broadcast((block, seeds))

        def keep(batches, shared=shared):
            block, seeds = shared.value
            for part in slices(batches):
                yield part.filter(pa.array([not find(block, seeds, t or "", min_score) for t in part.column(text_at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
