"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, dimension, ship_package

#: Rows decoded to Python objects at once, so that a batch of long texts is never held twice as a whole.
SLICE_ROWS = 256


#: Rows of an Arrow batch: whole texts are long, and the default of 10,000 rows would take tens of MB on both sides of a task.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table (all of them if none is named), to be sent to Python in small batches."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), whatever else ``docs`` carries, to be sent to Python in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of the edges (u, v), by alternating star contraction.

    Each round is two aggregations and two joins on the edge set and is checkpointed; the number of rounds is logarithmic in the
    longest path. Minima are combined before they are shuffled and the joins are plain equi-joins, so a hub is split at run time.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())


def first_and_previous(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rep) sorted by both: every rep with the first and the previous one of its key, as (u, v).

    Nothing of a key is held but two rows, however many it has, and it gets no more than two links a row.
    """
    held = None  # key, its first rep, its last rep
    for batch in batches:
        key, rep = (batch.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        key = np.concatenate([[held[0]] * 2 if held else [key[0]] * 2, key])
        rep = np.concatenate([held[1:] if held else [rep[0]] * 2, rep])
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        u, same = np.r_[rep, rep], np.r_[key[first] == key, np.r_[True, key[1:] == key[:-1]]]
        v = np.r_[rep[first], np.r_[rep[0], rep[:-1]]]
        ok = same & (u != v)
        held = (key[-1], rep[first[-1]], rep[-1])
        yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], names=["u", "v"])


def verified_pairs(texts: DataFrame, pairs: DataFrame, elements: Callable[[str], np.ndarray], similarity: float) -> DataFrame:
    """Of ``pairs`` (u, v) of doc_ids, those whose texts' sets of 64-bit ``elements`` have at least that Jaccard similarity.

    Only the sets of documents that are in a pair are built.
    """
    def sets(batches):
        for part in slices(batches):
            values = [elements(t).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.int64()))], names=["id", "s"])

    ids = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    wanted = texts.join(dimension(ids), F.col("doc_id") == F.col("id"), "left_semi")
    s = cut_lineage(wanted.mapInArrow(sets, "id long, s array<long>"))
    both = pairs.join(s.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(s.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(common >= F.lit(similarity) * (F.size("su") + F.size("sv") - common)).select("u", "v").distinct()


#: Members of a key whose sets a task holds at once, and members that are held against them there.
HELD, STREAMED = 128, 8192


def cross_links(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v) of verified pairs from rows (key, block, part, side, rep, root, s) sorted by the first four.

    Side 0 of a block is held (and in part 0 compared with itself), side 1 streams past it. Only members of different components are
    compared, and what a task has linked before counts as one component, so links follow the number of members, not of pairs.
    """
    place, reps, roots, sets, index, chief = None, [], [], [], None, {}

    def find(x: int) -> int:
        while (y := chief.get(x, x)) != x:
            chief[x] = chief.get(y, y)
            x = y
        return x

    def against(rep: int, root: int, s: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Links of a member to the first ``n`` held ones."""
        nonlocal index
        mine = find(root)
        others = [i for i in range(n) if find(roots[i]) != mine]
        if len(others) > 8:
            if index is None:
                elements = np.concatenate(sets)
                order = np.argsort(elements, kind="stable")
                index = elements[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
            first, last = np.searchsorted(index[0], s, "left"), np.searchsorted(index[0], s, "right")
            counts = last - first
            at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            common = np.bincount(index[1][at], minlength=len(sets))
        else:
            common = {i: len(np.intersect1d(sets[i], s, assume_unique=True)) for i in others}
        for i in others:
            if common[i] >= similarity * (len(sets[i]) + len(s) - common[i]) and find(roots[i]) != find(root):
                chief[find(roots[i])] = find(root)
                yield rep, reps[i]

    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for k, (key, block, part, side, rep, root) in enumerate(zip(*columns)):
            s = batch.column(6)[k].values.to_numpy().view(np.uint64)
            if (key, block, part) != place:
                place, reps, roots, sets, index, chief = (key, block, part), [], [], [], None, {}
            if side or part == 0:
                out += against(rep, root, s, len(sets))
            if not side:
                reps.append(rep)
                roots.append(root)
                sets.append(s)
                index = None
        yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in out], pa.int64()), pa.array([min(x) for x in out], pa.int64())], names=["u", "v"])


def alike_members(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, rep) of the members that agree in at least ``least`` bytes of their signatures with one of another component.

    Rows (key, block, part, side, rep, root, sig) are dealt and sorted like those of ``cross_links``.
    """
    place, reps, roots, sigs, told = None, [], [], np.zeros((0, 0), np.uint8), set()
    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for key, block, part, side, rep, root, sig in zip(*columns):
            mine = np.frombuffer(sig, np.uint8)
            if (key, block, part) != place:
                place, reps, roots, sigs, told = (key, block, part), [], [], np.zeros((HELD, len(mine)), np.uint8), set()
            if (side or part == 0) and reps:
                like = np.flatnonzero((sigs[: len(reps)] == mine).sum(axis=1) >= least)
                like = [i for i in like.tolist() if roots[i] != root]
                found = {rep, *(reps[i] for i in like)} - told if like else set()
                told |= found
                out += [(key, x) for x in found]
            if not side:
                if len(reps) == len(sigs):
                    sigs = np.concatenate([sigs, np.zeros_like(sigs)])
                sigs[len(reps)] = mine
                reps.append(rep)
                roots.append(root)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["key", "rep"])


def open_members(members: DataFrame) -> DataFrame:
    """``members`` (key, rep, root, ...) of the keys with several components, with how they are dealt: blocks, parts and ``own``, the block that a member is held in.

    The members of a key's largest component are held nowhere (null).
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    several = sizes.where("roots > 1").select(
        F.col("key").alias("k"), F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / HELD).cast("int").alias("blocks"),
        F.ceil(F.col("n") / STREAMED).cast("int").alias("parts"))
    return cut_lineage(members.join(several, F.col("key") == F.col("k")).withColumn(
        "own", F.when(F.col("root") != F.col("top"), F.pmod(F.xxhash64("rep"), "blocks").cast("int"))).drop("k", "top"))


def dealt(mixed: DataFrame, payload: DataFrame, tasks: int) -> DataFrame:
    """(key, block, part, side, rep, root, payload) sorted by the first four; ``payload``: id and one column."""
    own = payload.columns[1]
    held = mixed.where("own is not null").select("key", F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "rep", "root")
    past = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int").alias("part"),
                        F.lit(1).alias("side"), "rep", "root", "own").where("own is null or own > block").drop("own")
    rows = held.union(past).join(payload, F.col("rep") == F.col("id")).select("key", "block", "part", "side", "rep", "root", own)
    return rows.repartition(tasks, "key", "block", "part").sortWithinPartitions("key", "block", "part", "side")


def linked_by_keys(texts: DataFrame, reps: DataFrame, elements: Callable[[str], np.ndarray], similarity: float) -> DataFrame:
    """(u, v), u > v: verified links whose components are those of *all* pairs of ``reps`` (rep, keys[, sig]) that share a key.

    First every text is held against the first and the previous one of each key, which contracts crowds of near copies. A key whose
    members are in several components after that has all its pairs between components compared: its largest component streams past
    the others, these are held in blocks, and the members of a crowded key are dealt over blocks and parts. ``texts``: doc_id, text.

    ``sig``: a MinHash signature, a byte per component. With it, members that are like no member of another component by six standard deviations
    of the estimate drop out of a key before any set is built, so only few sets travel.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = reps.select(F.explode("keys").alias("key"), "rep").repartition(tasks, "key").sortWithinPartitions("key", "rep")
    pairs = postings.mapInArrow(first_and_previous, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = cut_lineage(verified_pairs(texts, cut_lineage(pairs.distinct()), elements, similarity))
    roots = connected_components(links)
    members = reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.explode("keys").alias("key"), "rep", F.coalesce("root", "rep").alias("root"))
    mixed = open_members(members)
    if "sig" in reps.columns:
        width = reps.select(F.max(F.length("sig"))).first()[0] or 1
        least = int(np.ceil(width * (similarity - 6 * np.sqrt(similarity * (1 - similarity) / width))))
        wanted = reps.select(F.col("rep").alias("id"), "sig")
        alike = dealt(mixed, wanted, tasks).mapInArrow(lambda batches: alike_members(batches, least), "key long, rep long").distinct()
        mixed = open_members(mixed.select("key", "rep", "root").join(cut_lineage(alike), ["key", "rep"], "left_semi"))

    def sets(batches):
        for part in slices(batches):
            values = [elements(t).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.int64()))], names=["id", "s"])

    wanted = texts.join(dimension(cut_lineage(mixed.select(F.col("rep").alias("id")).distinct())), F.col("doc_id") == F.col("id"), "left_semi")
    s = cut_lineage(wanted.mapInArrow(sets, "id long, s array<long>"))
    more = dealt(mixed, s, tasks).mapInArrow(lambda batches: cross_links(batches, similarity), "u long, v long")
    return links.union(cut_lineage(more.distinct()))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, as installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)
