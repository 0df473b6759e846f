"""SimHash near-duplicate groups through an inverted index on byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits share at least six of them: that is the
guaranteed minimum of the count filter. Posting lists of single bytes would pair up a fixed share of the corpus, so the postings
here are the 28 ways of choosing six positions with their bytes; a common posting *is* a tally of six or more. Members of one
posting differ in two known bytes only, hence a list has at most 65,536 different fingerprints at any corpus size. Verified
members are linked to one of their group instead of pairwise, so a crowd of near copies stays linear.

``similar_pairs`` reaches further out, to texts whose five-word shingle sets resemble each other by 0.8 or more. Their SimHashes differ in
about ten bits, beyond any guarantee of shared bytes, so it finds them by the MinHash bands of ``minhash`` (a pair at 0.8 shares one with
probability over 0.9999) and the exact similarity of the shingle sets decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, id_and_text, linked_by_keys, slices
from tidemark.llm.minhash import bands, signature
from tidemark.session import cut_lineage

SEED = 42
#: Largest number of differing bits that the index guarantees: two bytes of eight may differ.
MAX_BITS = 2
_CHUNK = 1 << 16
_PAIRS = list(combinations(range(8), 2))
SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of the 128 of two hashes, four standard deviations above what sets at 0.8 have.
_FAR = 36


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles with repeats; ASCII letters are lower-cased, words are runs without ASCII white space.

    Fewer words than a shingle: the whole sequence is the one shingle. No words: zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        part = words[start : min(start + _CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document; fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for part in slices(batches):
            fps = [_signed(fingerprint(t, shingle)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def posting_links(values: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) of the groups within one posting list: members at most ``max_bits`` apart, transitively."""
    v = np.sort(values.astype(np.int64))
    u = v.view(np.uint64)
    n = len(v)
    label = np.arange(n)
    if n <= 64:
        near = np.bitwise_count(u[:, None] ^ u[None, :]) <= max_bits
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            if (new == label).all():
                break
            label = new
    else:
        spread = np.bitwise_or.reduce(u ^ u[0])
        at = [i for i in range(8) if int(spread) >> (8 * i) & 255]
        rest = np.zeros(n, np.int64)
        for k, i in enumerate(at):
            rest |= ((u >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64) << (8 * k)
        index = np.full(1 << (8 * len(at)), -1)
        index[rest] = np.arange(n)
        flips = [1 << a for a in range(8 * len(at))]
        if max_bits > 1:
            flips += [a | b for a, b in combinations(flips, 2)]
        while True:
            old = label.copy()
            for f in flips:
                other = index[rest ^ f]
                ok = other >= 0
                label[ok] = np.minimum(label[ok], label[other[ok]])
            label = label[label]
            if (label == old).all():
                break
    moved = label != np.arange(n)
    return v[moved], v[label[moved]]


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): edges that connect every group of the distinct fingerprints ``fp`` and no two groups."""
    if not 0 < max_bits <= 2:
        raise ValueError("six shared bytes guarantee one or two differing bits")
    keys = []
    for k, (i, j) in enumerate(_PAIRS):
        kept = _signed(((1 << 64) - 1) ^ (255 << (8 * i)) ^ (255 << (8 * j)))
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(kept)).alias("kept")))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = (
        distinct.repartition(tasks, "fp").select("fp", F.explode(F.array(*keys)).alias("key"))
        .groupBy("key").agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1).select("fps")
    )

    def verify(batches):
        for part in slices(batches, 4096):
            out = [posting_links(np.array(x, np.int64), max_bits) for x in part.column(0).to_pylist()]
            u, v = (np.concatenate([o[s] for o in out]) if out else np.zeros(0, np.int64) for s in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return postings.mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): every row of ``docs`` with the smallest doc_id reachable over links of at most ``max_bits``.

    Null text is empty text; empty texts share fingerprint zero and link like any other. A null doc_id is never a group's
    representative (a group of null ids only has a null component). Repeated rows stay repeated. No rows: no rows.
    """
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    lowest = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(fingerprint_links(lowest.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = lowest.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    components = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = rooted.join(components, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles of a text in lower case (ASCII); fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def _neighbours(batches):
    """Of rows sorted by posting: every text with the first and the previous one of its posting, if few bits differ.

    Nothing of a posting is held but two rows, however many texts it has. ``similar_pairs`` does not use it any more.
    """
    held = None  # key, and (rep, a, b) of the posting's first row and of the last row
    for batch in batches:
        key, *columns = (batch.column(i).to_numpy() for i in range(4))
        if not len(key):
            continue
        before = np.array([held[0]] * 2 if held else [-1, -1])
        old = held[1] if held else [(0, 0, 0)] * 2
        key = np.concatenate([before, key])
        rep, a, b = (np.concatenate([np.array([old[0][i], old[1][i]], np.int64), c]) for i, c in enumerate(columns))
        at = np.arange(len(key))
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.maximum.accumulate(np.where(new, at, 0))
        at = at[2:]
        us, vs = [], []
        for other in (first[2:], at - 1):
            ok = key[at] == key[other]
            ok &= (np.bitwise_count((a[at] ^ a[other]).view(np.uint64)) + np.bitwise_count((b[at] ^ b[other]).view(np.uint64))) <= _FAR
            ok &= rep[at] != rep[other]
            us.append(rep[at[ok]])
            vs.append(rep[other[ok]])
        f, e = first[-1], len(key) - 1
        held = (key[e], [(rep[f], a[f], b[f]), (rep[e], a[e], b[e])])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def similar_pairs(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v), u > v: links between documents whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

    Equal texts are represented by their smallest doc_id; texts without one, or without words, are left out. Every link is verified, and
    every such pair that shares a signature band is connected by links; a pair is missed if it shares none (three in 100,000 at 0.8).
    """

    def keyed(batches):
        for part in slices(batches):
            rows = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                values = shingle_set(t, shingle)
                if d is not None and len(values):
                    digest = xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "replace").lower().split()))
                    rows.append((d, digest, bands(signature(values))))
            columns = list(zip(*rows)) or [[]] * 3
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "digest", "keys"])

    texts = id_and_text(docs, id_col, text_col)
    hashed = texts.mapInArrow(keyed, "doc_id long, digest binary, keys array<long>")
    reps = hashed.groupBy("digest").agg(F.min(F.struct("doc_id", "keys")).alias("r")).select(F.col("r.doc_id").alias("rep"), F.col("r.keys").alias("keys"))
    return linked_by_keys(texts, cut_lineage(reps), lambda t: shingle_set(t, shingle), similarity)


def duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): groups over the links of ``near_duplicates`` and of ``similar_pairs`` together.

    A null doc_id is never a representative; its row gets the group of its text's fingerprint, if that has a named document.
    """
    groups = cut_lineage(near_duplicates(docs, id_col=id_col, text_col=text_col).select("doc_id", "component_id"))
    of = groups.where("doc_id is not null").distinct()
    links = similar_pairs(docs, similarity=similarity, id_col=id_col, text_col=text_col)
    links = links.join(of.select(F.col("doc_id").alias("u"), F.col("component_id").alias("cu")), "u").join(of.select(F.col("doc_id").alias("v"), F.col("component_id").alias("cv")), "v")
    roots = connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    return groups.join(roots, F.col("component_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
