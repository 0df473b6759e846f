"""MinHash fingerprints and the near-duplicate pairs that share signature bands.

A text is the set of its shingles of five words. A fingerprint keeps, for each of many universal hash functions h(x) = (a x + b)
mod 2^64 >> 32 with odd a, the smallest value over the set; the share of equal components estimates the Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, id_and_text, linked_by_keys, slices
from tidemark.session import cut_lineage, dimension

SHINGLE = 5
PERMUTATIONS = 128
SIMILARITY = 0.8
#: Bands of four components: a pair at 0.8 shares one with probability 1 - (1 - 0.8^4)^20 > 0.9999.
BANDS, BAND_ROWS = 20, 4
_CHUNK = 256


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)


_A, _B = _functions(PERMUTATIONS)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles of a lower-cased text, repeats included; fewer words are one shingle, no words none."""
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct ones of ``shingle_hashes``, sorted."""
    return np.unique(shingle_hashes(text, size))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16-bit MinHash components (repeats don't matter); all zero for an empty set, never all zero otherwise."""
    if not len(hashes):
        return np.zeros(PERMUTATIONS, "<u2")
    low = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    values = np.empty((min(_CHUNK, len(hashes)), PERMUTATIONS), np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK, None]
        v = values[: len(part)]
        np.multiply(part, _A, out=v)
        np.add(v, _B, out=v)
        np.minimum(low, v.min(axis=0), out=low)
    low >>= np.uint64(32)  # as if every value had been shifted first
    # the smallest values of a large set all have few leading digits, so the kept part is mixed
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return np.maximum(mixed, 1).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures (two empty sets: 1)."""
    return float((a == b).mean())


def text_of(sig: np.ndarray) -> str:
    return sig.astype("<u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down, code points) replaced by the first as many of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bands(sig: np.ndarray) -> list[int]:
    """One 64-bit key per band: the band's number and its four components, mixed."""
    parts = sig[: BANDS * BAND_ROWS].astype("<u2").view("<u8")
    keys = (parts + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64).tolist()


def near_duplicate_links(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): the documents that are not their class's smallest doc_id.

    Classes are linked by pairs that share a signature band and whose shingle sets have a Jaccard similarity of at least
    ``similarity``; every such pair is in one class. Equal texts are one text with its smallest doc_id. Within a band's key a text is held against
    the first and the previous one, so a crowd of near copies gets links in proportion to its size, and then against all that are not in its
    class by these links (``linked_by_keys``). Empty texts form a class of their own; null ids are left out.
    """

    def keyed(batches):
        for part in slices(batches):
            rows = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if d is not None:
                    sig = signature(shingle_hashes(t))
                    rows.append((d, hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest(), bands(sig), (sig & 255).astype(np.uint8).tobytes()))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "digest", "keys", "sig"])

    texts = id_and_text(docs, id_col, text_col)
    rows = cut_lineage(texts.mapInArrow(keyed, "doc_id long, digest binary, keys array<long>, sig binary"))
    reps = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "keys", "sig")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.keys").alias("keys"), F.col("r.sig").alias("sig"))
    reps = cut_lineage(reps.drop("digest"))
    roots = connected_components(linked_by_keys(texts, reps, shingles, similarity))
    named = rows.select("doc_id", "digest").join(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest")
    classes = named.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    return classes.where("doc_id <> class_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


_LOWEST = -(2**63)


def in_descending_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, copy, key, doc_id, tie, class_id, text): documents dealt by ranges of ids, sorted within tasks, each range followed by a copy of what
    comes next; texts are compressed for the way.

    Ranges are bounded by ids that occur, so that the document after a range is known to be the one with the bound below; it is
    sent to both. Equal ids follow each other by the hash of their text; a null id comes last. The largest id is also sent behind
    the smallest one.
    """
    spark = docs.sparkSession
    extra = docs["class_id"] if "class_id" in docs.columns else docs[id_col].cast("long")
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), extra.alias("class_id"))
    keyed = keyed.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), F.xxhash64("text").alias("tie"), "class_id")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * tasks
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 8 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def largest(batches):
        best = {}
        for part in batches:
            key = part.column(0).to_numpy()
            bucket = np.searchsorted(cuts, key)
            for b in np.unique(bucket):
                best[b] = max(best.get(b, _LOWEST), int(key[bucket == b].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], names=["bucket", "top"])

    tops = keyed.select("key").mapInArrow(largest, "bucket long, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()
    tops = np.array(sorted(r.top for r in tops), np.int64)  # one per range that has documents

    def deal(batches):
        names = ["bucket", "copy", "key", "doc_id", "tie", "class_id", "text"]
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in slices(batches):
            key = part.column(2).to_numpy()
            bucket = np.searchsorted(tops, key)
            again = np.flatnonzero(tops[bucket] == key)
            rows = pa.array(np.r_[np.arange(len(key)), again])
            copy = np.r_[np.zeros(len(key), np.int32), np.ones(len(again), np.int32)]
            to = np.r_[bucket, (bucket[again] + 1) % len(tops)].astype(np.int32)
            text = pa.array([pack(t.encode("utf-8", "replace")) for t in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(copy), *(c.take(rows) for c in (part.column(2), part.column(0), part.column(3), part.column(4), text))], names=names)

    dealt = keyed.mapInArrow(deal, "bucket int, copy int, key long, doc_id long, tie long, class_id long, text binary")
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "copy", F.desc("key"), "tie")


_FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they and the next document's are.

    The next document is the one with the next smaller doc_id (after the last: the first), equal ids in the order of their texts'
    hashes, null ids last. Null text is empty text; an empty text's fingerprint is all zero, and two empty texts are alike (1).
    A single document is its own next one. No rows: no rows. ``class_id`` is the smallest doc_id of the document's near-duplicate class (see
    ``near_duplicate_links``), its own where it has no other, null for a null id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("class_id", pa.int64())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # (bucket, doc_id, text, signature, class_id) that waits for the next document
        for part in slices(batches):
            rows = []
            for bucket, copy, doc, class_id, packed in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 5, 6))):
                if copy and (last is None or last[0] != bucket):
                    continue
                text = unpack(packed).decode()
                sig = signature(shingle_hashes(text))
                if last is not None and last[0] == bucket:
                    changed = edited(last[2], text)
                    other = signature(shingle_hashes(changed))
                    rows.append((last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), text_of(last[3]), text_of(other),
                                 likeness(last[3], other), likeness(last[3], sig), last[4]))
                last = None if copy else (bucket, doc, text, sig, class_id)
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    links = cut_lineage(near_duplicate_links(docs, SIMILARITY, id_col, text_col)).withColumnsRenamed({"doc_id": "__id", "class_id": "__class"})
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # documents that have an earlier near copy, broadcast up to a checked size and else joined by shuffle
    classed = own.join(dimension(links), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.coalesce("__class", "doc_id").alias("class_id"))
    return in_descending_order(classed).mapInArrow(run, _FINGERPRINTS)
