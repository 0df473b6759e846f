import random

import corpus_pipeline as cp
from tidemark.llm import decontaminate, packing, substring_dedup
from tidemark.llm.common import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentences(rnd, n, letters="abcdefgh"):
    return " ".join(" ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(rnd.randint(6, 12))).capitalize() + "." for _ in range(n))


def make(spark, folder):
    rnd = random.Random(1)
    items = [" ".join("".join(rnd.choice("klmnopq") for _ in range(4)) for _ in range(25)) for _ in range(6)]
    passage = sentences(rnd, 8)
    texts = {i: sentences(rnd, 6) for i in range(60)}
    for i in (11, 12, 40):
        texts[i] = texts[5]
    texts[33] = texts[7].replace(texts[7].split()[20], texts[7].split()[20])
    for i in (20, 21, 22):
        texts[i] += "\n" + passage
    for i, k in ((30, 0), (31, 3)):
        texts[i] += " " + items[k] + "."
    texts |= {70: None, 71: "", 72: "123 %%% ...", 73: sentences(rnd, 900)}
    rows = [(i, t, "en" if i % 2 else None, "src", len(t or "")) for i, t in texts.items()]
    rows += [(9, texts[9], "en", "src", len(texts[9]))] + [(None, sentences(rnd, 4), "en", "src", 1)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, passage


def test_stages_one_by_one(spark, tmp_path):
    texts, passage = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = docs.collect()
    ids = {n: sorted((r.doc_id for r in rows), key=str) for n, rows in kept.items()}
    want = [*range(60), 9, 73, None, None]
    assert ids["language_id"] == sorted(want, key=str)
    want = [i for i in range(60) if i not in (11, 12, 33, 40)] + [73, None, None]
    assert ids["simhash_near_dedup"] == sorted(want, key=str) == ids["substring_dedup"]
    cleaned = {r.doc_id: r for r in kept["substring_dedup"]}
    assert passage in cleaned[20].text
    for i in (21, 22):
        assert texts[i].startswith(cleaned[i].text) and len(cleaned[i].text) < len(texts[i]) - 300 and cleaned[i].n_chars == len(cleaned[i].text)
    assert all(cleaned[i].text == texts[i] for i in (0, 1, 2, 3, 5, 30, 59, 73))
    assert ids["decontamination"] == sorted([i for i in want if i not in (30, 31)], key=str)
    packed = kept["best_fit_packing"]
    tokens = sum(len(packing.token_ids(r.text or "", vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))) + 1 for r in kept["decontamination"])
    assert sum(r.length for r in packed) == tokens and len({r.sequence_id for r in packed}) <= -(-tokens // 2048) + 1


def test_run_equals_the_stages(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (str(r.doc_id), r.piece, r.ids_crc32)
    want, got = sorted(docs.collect(), key=key), sorted(cp.run(spark, str(tmp_path)).collect(), key=key)
    assert [key(r) for r in want] == [key(r) for r in got]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_stay(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as fp", "'x' as spans", "doc_id as component_id", "2 as text_key", "3 as h")
    for _, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert docs.count() > 50 and {r.spans for r in docs.collect()} == {"x"}
    assert substring_dedup and decontaminate
