import re

import corpus_pipeline
from semloom.llm import tokens
from tests.llm import test_decontaminate, test_neardup

PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before, kept = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, d), "test")
        if name != "packing":
            assert out.columns == columns and out.count() <= before
            assert out.join(docs, columns, "left_semi").count() == out.count()
            before = out.count()
            kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs, last = out, docs
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in kept["quality_classifier"] for i in clean) >= 0.98 * len(clean)
    assert kept["language_id"] == kept["quality_classifier"]
    tokenizer = tokens.load()
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in last.collect()}
    have = {}
    for r in docs.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want


def test_duplicates_and_contamination_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    for k, row in enumerate(rows[:30]):  # copies with one word changed, and texts with a passage of an item inside them
        words = row["text"].split(" ")
        rows.append(row | {"doc_id": 10_000 + k, "text": " ".join([*words[: len(words) // 2], f"changed{k}", *words[len(words) // 2 + 1 :]])})
        loud = re.sub("[a-z]", lambda x: x[0].upper(), items[k % len(items)][1])
        rows.append(row | {"doc_id": 20_000 + k, "text": f"own{k} {row['text']} {loud} end{k}"})
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema).repartition(5)

    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, d).select("doc_id").collect()}
    want = {i for i, _, _, stays in test_neardup.brute([(r["doc_id"], r["text"]) for r in rows]) if stays}
    assert kept == want and len(want) < len(rows) - 20

    windows = {}
    for _, text in items:
        w = test_decontaminate.words(text)
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[s : s + n]) for s in range(len(w) - n + 1) if n)
    hit = set()
    for r in rows:
        w = test_decontaminate.words(r["text"])
        if any(tuple(w[s : s + n]) in found for n, found in windows.items() if n for s in range(len(w) - n + 1)):
            hit.add(r["doc_id"])
    kept = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, d).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows} - hit and len(hit) >= 30


def test_edges(spark):
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string, language string"
    some = spark.createDataFrame([(1, "the of and", "en", "s", 3, "x", "y"), (1, "the of and", "en", "s", 3, "x", "y"), (None, None, None, None, None, None, None), (2, "", None, "s", 0, None, None)], schema)
    for docs in (some, some.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, d), "edge")
            if name == "minhash_near_dedup":  # one row an id stays, and rows without an id do
                ids = [r.doc_id for r in docs.select("doc_id").collect()]
                assert len(ids) == len(set(ids))
        assert docs.columns[: len(PIECES)] == PIECES


def test_different_texts_of_an_id_stay(spark):
    rows = [(1, "one text of this id"), (1, "one text of this id"), (1, "and another that nobody else has"), (2, "one text of this id")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect())) == sorted(set(rows[:3]))
