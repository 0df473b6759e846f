"""Exact repeats of passages: normalised units, one global table of digests, the earliest occurrence stays.

Units are lines, cut further at sentence ends; sentences of fewer than ``min_unit_words`` words that follow each other are one
unit, and too small a unit is passed over. The cuts depend on nearby text only, so a passage gives the same units wherever it is
pasted. Unit rows carry a digest and the original code-point offsets, never text. A repeat is removed when the unbroken run of repeats it belongs to has
at least ``min_run_words`` words, which leaves stock phrases and headings of clean documents alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, slices, small_batches
from tidemark.session import cut_lineage

MIN_UNIT_WORDS = 8
MIN_RUN_WORDS = 25
_SPACE = re.compile(r"\s*")
_END = re.compile(r"[.!?](?=\s)|\n")


def units(text: str, min_words: int = MIN_UNIT_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text; offsets are code points of the original text, white space excluded."""
    out, at, short = [], 0, 0  # ``short``: start of the short sentences not yet read
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))

    def add(start: int, end: int) -> None:
        raw = text[start:end]
        words = raw.lower().split()
        if len(words) >= min_words:
            digest = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
            out.append((start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip()), len(words), digest))

    for end in ends:
        if len(text[at:end].split()) >= min_words:
            add(short, at)
            add(at, end)
            short = end
        at = end
    add(short, at)
    return out


_UNITS = "doc_id long, text_key long, unit int, start int, end int, words int, digest binary"


def unit_rows(docs: DataFrame, min_words: int = MIN_UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit. ``text_key`` is a hash of the text, so documents that share a doc_id but not the text stay apart."""
    keyed = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                        ("words", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for part in slices(batches):
            columns = [[] for _ in schema]
            for key in zip(*(part.column(i).to_pylist() for i in range(3))):
                for k, unit in enumerate(units(key[2], min_words)):
                    for column, value in zip(columns, (key[0], key[1], k, *unit)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return keyed.mapInArrow(run, _UNITS)


def repeated_spans(
    docs: DataFrame, min_unit_words: int = MIN_UNIT_WORDS, min_run_words: int = MIN_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, span_start, span_end, n_units, n_words, kept_doc_id, kept_start): one row per passage to remove.

    ``span_start``/``span_end`` are code points in the original text (end exclusive); ``kept_*`` name the place where the first
    unit of the passage stays. Occurrences rank by doc_id (null last), start, text hash. Null or empty texts have no units. Rows
    equal in doc_id and text are one document and get one set of spans. No rows: no rows.

    The digest table is one aggregation (combined before the shuffle) and the way back is a plain equi-join, which run-time skew
    handling splits when one passage makes up a large part of the corpus.
    """
    rows = cut_lineage(unit_rows(docs, min_unit_words, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "text_key")
    first = (
        rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("kept"))
        .where("n > 1").select("digest", "kept")
    )
    again = rows.join(first, "digest").where(place != F.col("kept")).select(
        "doc_id", "text_key", "unit", "start", "end", "words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))
    again = again.groupBy("doc_id", "text_key", "unit").agg(*(F.first(c).alias(c) for c in ("start", "end", "words", "kept_doc_id", "kept_start")))
    order = Window.partitionBy("doc_id", "text_key").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.row_number().over(order))
    return (
        runs.groupBy("doc_id", "text_key", "run")
        .agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"),
             F.min_by(F.struct("kept_doc_id", "kept_start"), "unit").alias("kept"))
        .where(F.col("n_words") >= min_run_words)
        .select("doc_id", "text_key", "span_start", "span_end", "n_units", "n_words", "kept.kept_doc_id", "kept.kept_start")
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a cut leaves one line break, or one blank inside a line."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        before = text[at:start].rstrip()
        after = _SPACE.match(text, end).end()
        gap = text[at + len(before) : start] + text[end:after]
        out.append(before + ("\n" if "\n" in gap else " ") if before else "")
        at = after
    return ("".join(out) + text[at:]).rstrip() if out else text


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text`` and ``n_chars`` set to the new length where the column exists.

    Documents without spans keep their text as it is (null included).
    """
    small_batches(docs.sparkSession)
    grouped = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    keyed = docs.withColumn("__text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(grouped.withColumnsRenamed({"doc_id": "__id", "text_key": "__key", "spans": "__spans"}),
                        docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")

    @F.pandas_udf("string")
    def without(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else cut(t, [(x["span_start"], x["span_end"]) for x in s]) for t, s in zip(text, spans)], dtype=object)

    out = joined.withColumn("text", without("text", "__spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
