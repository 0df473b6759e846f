"""The corpus pipeline: every stage reads what its predecessor kept and its decisions take effect for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, packing, simhash, substring_dedup
from tidemark.llm.common import table, vocabulary
from tidemark.session import cut_lineage, dimension


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter in it) go; every other one stays as it is."""
    labelled = docs.where(F.crc32(docs["doc_id"].cast("string")) % 3 != 1).select("text", "lang")
    model = language.fit(labelled)
    return language.predict(docs, model, lang_col="__lang", score_col="__score").where(F.col("__lang") != language.UNDETERMINED).drop("__lang", "__score")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Documents are linked if their SimHashes over three-word shingles differ in two bits or fewer, or if their sets of five-word shingles
    resemble each other by 0.8 or more. Rows that repeat a doc_id count as one document and one of them stays; rows without a doc_id can't be named and stay.
    """
    groups = cut_lineage(simhash.duplicate_groups(docs).select(F.col("doc_id").alias("__id"), "component_id"))
    gone = groups.where("__id <> component_id").select("__id").distinct()
    again = groups.where("__id is not null").groupBy("__id").count().where("count > 1").select("__id")
    # lists of ids, broadcast up to a checked size and else joined by shuffle
    kept = docs.join(dimension(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    again = dimension(cut_lineage(again))
    once = kept.join(again, F.col("doc_id") == F.col("__id"), "left_anti")
    several = kept.join(again, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(several)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has already are cut out of the text; every document stays."""
    return substring_dedup.remove_spans(docs, substring_dedup.repeated_spans(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in training sequences."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_cut),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages hash, fit models and align words, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; every stage's result is written once, so no stage is computed again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
