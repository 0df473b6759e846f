"""Hard negatives by threshold joins over an inverted index with norm bounds.

Anchors are joined in blocks with all rows: a pair counts only if its inner product reaches the anchor's threshold. A task sorts
its rows by label and holds them dimension by dimension. The leading dimensions of a row are left out of the index as long as their norm
times the largest anchor norm stays under the least threshold: on their own they reach nothing. Partial scores are accumulated over the
indexed dimensions, a slab at a time, and a pair is dropped once its partial score plus the product of the two remaining
norms is below its anchor's threshold; survivors get their exact score.

Thresholds start high, from the scores of a bounded sample, and are lowered until every window is full: first the best rows of the
anchor's own label (the positives), then for each positive the best rows of other labels whose scores lie in its window. A task
keeps only the first few rows of every window, so groups of copies and frequent labels cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.session import cut_lineage

POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this share (in hundredths) of its positive, and at most the positive's score.
LEAST_SHARE = 80
#: Anchors that meet all rows in one pass, rows that a task multiplies at once, and rows of the sample behind the first thresholds.
ANCHOR_BLOCK, ROW_BLOCK, SAMPLE_ROWS = 16384, 2048, 2048
ANCHORS_AT_ONCE = 512
#: Dimensions accumulated at once.
SLAB = 16
_LOWEST = -(1 << 62)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, x): every component as floor(scale * component).

    Rows with a null id, label or vector or with a null or non-finite component take no part; neither do vectors without components.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True)))
    return vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


@dataclass
class Anchors:
    """A block of anchors: ids, labels, vectors (exact integers as doubles) and, per anchor, what it still looks for."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    threshold: np.ndarray
    #: Anchors x positives: upper and lower ends of the windows of other labels; None while positives are looked for.
    upper: np.ndarray | None = None
    lower: np.ndarray | None = None

    def part(self, which: np.ndarray) -> Anchors:
        some = lambda a: None if a is None else a[which]
        return Anchors(self.ids[which], self.labels[which], self.x[which], self.threshold[which], some(self.upper), some(self.lower))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows x dimensions; shorter vectors are filled with zeros, of longer ones only the anchors' dimensions count."""
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - offsets[:-1][row]
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Rows x (dimensions + 1): norm of the first d components."""
    return np.sqrt(np.c_[np.zeros(len(x)), np.cumsum(x * x, axis=1)])


def reaching(anchors: np.ndarray, threshold: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose inner product is at least the anchor's threshold."""
    if not len(anchors) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    width = rows.shape[1]
    a_norm, r_norm = _norms(anchors), _norms(rows)
    # a row is indexed from the slab in which its leading dimensions could first reach the least threshold on their own
    least, most = threshold.min(), a_norm[:, -1].max()
    edges = [*range(0, width, SLAB), width]
    bound = r_norm[:, edges] * most * (1 + 1e-9) + 1e-6
    omitted = (bound < least).sum(axis=1) - 1 if least > 0 else np.zeros(len(rows), np.int64)
    order = np.argsort(omitted, kind="stable")  # rows that are indexed from the first slabs on stand first
    rows, r_norm, omitted = rows[order], r_norm[order], omitted[order]
    live = np.flatnonzero(omitted < len(edges) - 1)  # the others can't reach any threshold
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    partial = np.zeros((len(anchors), len(live)))
    pairs = None
    for s in range(len(edges) - 2, -1, -1):  # from the last slab to the first
        lo, hi = edges[s], edges[s + 1]
        if pairs is None:
            n = int(np.searchsorted(omitted[live], s, "right"))  # the postings of this slab
            partial[:, :n] += anchors[:, lo:hi] @ rows[:n, lo:hi].T
            # what the dimensions before this slab, or the omitted ones of a row, can add at most
            rest = np.minimum(omitted[live], len(edges) - 2)
            before = np.maximum(np.array(edges)[rest], lo) if n < len(live) else np.full(len(live), lo)
            open_norm = r_norm[live, before]
            alive = partial + a_norm[:, before] * open_norm[None, :] * (1 + 1e-9) + 1e-6 >= threshold[:, None]
            if alive.mean() < 0.1 or s == 0:
                a, r = np.nonzero(alive)
                pairs = a, r, partial[a, r]
        else:
            a, r, score = pairs
            mine = omitted[r] <= s
            score = score.copy()
            score[mine] += np.einsum("ij,ij->i", anchors[a[mine], lo:hi], rows[r[mine], lo:hi])
            before = np.maximum(np.array(edges)[np.minimum(omitted[r], len(edges) - 2)], lo)
            ok = score + a_norm[a, before] * r_norm[r, before] * (1 + 1e-9) + 1e-6 >= threshold[a]
            pairs = a[ok], r[ok], score[ok]
    a, r, score = pairs
    # the omitted dimensions of the survivors
    for s in range(len(edges) - 1):
        mine = omitted[r] > s
        score[mine] += np.einsum("ij,ij->i", anchors[a[mine], edges[s] : edges[s + 1]], rows[r[mine], edges[s] : edges[s + 1]])
    ok = score >= threshold[a]
    return a[ok], order[r[ok]], score[ok]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` entries of every group, by falling score, then by id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < n]


def _found(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, slot, row id, score) of the rows that belong to a window; slot 0 while positives are looked for."""
    out = []
    for label in np.unique(anchors.labels):
        every = np.flatnonzero(anchors.labels == label)
        rows = np.flatnonzero((labels == label) if anchors.upper is None else (labels != label))
        of_label = x[rows]
        some = [every[s : s + ANCHORS_AT_ONCE] for s in range(0, len(every), ANCHORS_AT_ONCE)]
        got = [(mine[a], rows[r], score) for mine in some for a, r, score in [reaching(anchors.x[mine], anchors.threshold[mine], of_label)]]
        a, r, score = (np.concatenate([g[i] for g in got]) for i in range(3))
        if anchors.upper is None:
            other = ids[r] != anchors.ids[a]
            out.append((a[other], np.zeros(other.sum(), np.int64), ids[r[other]], score[other]))
        else:
            for k in range(anchors.upper.shape[1]):
                fits = (score <= anchors.upper[a, k]) & (score >= anchors.lower[a, k])
                out.append((a[fits], np.full(fits.sum(), k), ids[r[fits]], score[fits]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _scan(rows: DataFrame, anchors: Anchors, first: int) -> DataFrame:
    """(place, slot, id, score): the first rows of every window over all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        # a task carries its best rows of every window along, so its output follows the windows, not its rows
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        width = mine.x.shape[1]
        for batch in batches:
            for s in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(s, ROW_BLOCK)
                new = _found(mine, part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width))
                if len(new[0]):
                    kept = tuple(np.concatenate(p) for p in zip(kept, new))
                    best = _first(kept[0] * (1 << 16) + kept[1], kept[3], kept[2], first)
                    kept = tuple(k[best] for k in kept)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2]), pa.array(kept[3].astype(np.int64))], names=["place", "slot", "id", "score"])

    best = Window.partitionBy("place", "slot").orderBy(F.desc("score"), "id")
    return rows.select("id", "label", "x").mapInArrow(run, "place long, slot long, id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)


def _fill(rows: DataFrame, anchors: Anchors, steps: np.ndarray, first: int) -> list[DataFrame]:
    """Tables (anchor_id, slot, rank, id, score) of all windows: thresholds follow ``steps`` (anchors x levels, falling) until all are full.

    The windows stay in Spark; the driver learns how full those of this block of anchors are.
    """
    spark = rows.sparkSession
    slots = 1 if anchors.upper is None else anchors.upper.shape[1]
    left, out, level = np.arange(len(anchors.ids)), [], 0
    while len(left):
        part = anchors.part(left)
        part.threshold = steps[left, level].astype(np.float64)
        got = cut_lineage(_scan(rows, part, first))
        counts = got.groupBy("place", "slot").count().toArrow()
        full = np.zeros((len(left), slots), np.int64)
        full[counts.column("place").to_numpy(), counts.column("slot").to_numpy()] = counts.column("count").to_numpy()
        # a window is done if it is full, or if the threshold is at its lower end
        ends = np.full((len(left), 1), float(_LOWEST)) if part.lower is None else part.lower
        done = ((full >= first) | (part.threshold[:, None] <= ends)).all(axis=1)
        places = np.flatnonzero(done)
        named = spark.createDataFrame(pa.table([pa.array(places), pa.array(part.ids[places])], names=["place", "anchor_id"]), "place long, anchor_id long")
        out.append(got.join(F.broadcast(named), "place").select("anchor_id", "slot", "rank", "id", "score"))
        left, level = left[~done], level + 1
    return out


def _levels(scores: np.ndarray, lowest: np.ndarray, wanted: float) -> np.ndarray:
    """Anchors x levels of falling thresholds: the sample's scores at growing ranks (-inf: no score), and at last the lowest one."""
    falling = -np.sort(-scores, axis=1)
    ranks = np.unique(np.clip(np.array([wanted, 4 * wanted, 32 * wanted]).astype(int), 0, falling.shape[1] - 1)) if falling.shape[1] else np.zeros(0, int)
    picked = np.c_[falling[:, ranks], lowest]
    return np.minimum.accumulate(np.where(np.isfinite(picked), np.maximum(picked, lowest[:, None]), lowest[:, None]), axis=1)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (id, label, x).

    ``anchor`` says which rows are anchors. An anchor's positives are its best other rows of its label; for each of them the best rows of
    other labels with ``least_share`` * positive <= 100 * negative <= 100 * positive are returned, ranked from 1. Scores are integer inner
    products (below 2^53), ties go by smaller id. A row that is repeated counts as often as it stands, but is one anchor, and no row with the anchor's
    own id is its positive. Vectors are compared on the anchor's dimensions; missing ones count as zero. Anchors are stated queries: they meet all rows in blocks of
    bounded size. Without anchors, positives or negatives there are no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = cut_lineage(rows)
    chosen = rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
    dealt = Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    chosen = cut_lineage(chosen.withColumn("block", F.floor((F.row_number().over(dealt) - 1) / (ANCHOR_BLOCK // 64)).cast("int")))
    blocks, width = chosen.agg(F.max("block"), F.max(F.size("x"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if blocks is None:
        return spark.createDataFrame([], schema)
    sampled = rows.select("id", "label", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    s_ids, s_labels, s_x = sampled["id"].to_numpy(), sampled["label"].to_numpy(), _matrix(sampled["x"].combine_chunks(), width)
    scale = len(s_ids) / rows.count()  # share of the rows that are in the sample

    def load(table: DataFrame) -> tuple[Anchors, np.ndarray, np.ndarray]:
        """A block of anchors, their scores with the sample, and which sample rows have their label."""
        got = table.toArrow()
        a = Anchors(got["id"].to_numpy(), got["label"].to_numpy(), _matrix(got["x"].combine_chunks(), width), np.zeros(got.num_rows))
        if "scores" in got.column_names:
            filled = [(x + [None] * positives)[:positives] for x in got["scores"].to_pylist()]
            a.upper = np.array([[-1.0 if v is None else float(v) for v in x] for x in filled])
            # a missing positive has an empty window
            a.lower = np.array([[np.inf if v is None else float(-((-least_share * v) // 100)) for v in x] for x in filled])
        return a, a.x @ s_x.T, s_labels[None, :] == a.labels[:, None]

    best: list[DataFrame] = []
    for block in range(blocks + 1):
        a, scores, same = load(chosen.where(F.col("block") == block).select("id", "label", "x"))
        mine_too = same & (s_ids[None, :] != a.ids[:, None])
        best += _fill(rows, a, _levels(np.where(mine_too, scores, -np.inf), np.full(len(a.ids), float(_LOWEST)), positives * scale), positives)
    # a negative score leaves no room for negatives
    best_ = cut_lineage(_union(best).where("score >= 0"))
    windows = best_.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda v: v["score"]).alias("scores"))
    chosen = cut_lineage(chosen.join(windows, "id"))
    found: list[DataFrame] = []
    for block in range(blocks + 1):
        a, scores, same = load(chosen.where(F.col("block") == block).select("id", "label", "x", "scores"))
        if not len(a.ids):
            continue
        top = np.where(a.upper >= 0, a.upper, np.inf).min(axis=1)
        inside = ~same & (scores <= top[:, None])
        found += _fill(rows, a, _levels(np.where(inside, scores, -np.inf), a.lower.min(axis=1), negatives * scale), negatives)
    if not found:
        return spark.createDataFrame([], schema)
    # slot k of an anchor is its positive of rank k + 1
    slots = best_.select("anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return _union(found).join(slots, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; of every seventh vec_id the label is moved on by one first."""
    moved = F.when(F.col("id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(quantised(vectors).withColumn("label", moved), F.col("id") % 100 == 0)


def report_sql() -> str:
    """The same by comparing all anchors with all rows."""
    return f"""WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS anchor_id, r.id AS other, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM r a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LEAST_SHARE} * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""
