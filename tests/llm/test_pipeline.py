"""Each stage of the corpus pipeline on planted documents, and the stages together."""

import random
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from pyspark.sql import functions as F

from cloudloom.llm.common import cut


def texts(rng, n):
    return " ".join(f"w{rng.randrange(4000)}x" for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    rows, marks = [], []
    passage, item = texts(rng, 70), texts(rng, 30)
    for i in range(300):
        t = texts(rng, 100)
        if i % 6 == 0:
            t = " ".join(w if k % 12 else rng.choice(["grobble", "snark"]) for k, w in enumerate(t.split()))
        marks.append((i, 1, int(i % 6 == 0)))
        rows.append((i, t, "en", "s", len(t)))
    copy = rows[1][1]
    rows += [(300, copy, "en", "s", len(copy)), (301, copy + " tail", "en", "s", len(copy) + 5), (302, texts(rng, 50) + " " + passage, "en", "s", 1), (303, passage + " " + texts(rng, 50), "en", "s", 1), (304, texts(rng, 40) + " " + item + " " + texts(rng, 40), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    everything = {r[0] for r in rows}
    assert everything - seen["toxicity"] == {i for i in range(300) if i % 6 == 0}
    assert seen["toxicity"] - seen["ngram_jaccard"] == {300, 301}
    assert seen["ngram_jaccard"] == seen["substring_dedup"]
    assert seen["substring_dedup"] - seen["decontamination"] == {304}
    assert seen["packing"] == seen["decontamination"]
    passages = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert passage in passages[302] and len(passages[303].split()) <= 56
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {tuple(r) for r in ran.collect()} == {tuple(r) for r in docs.collect()}


def test_results_of_stages_stay_readable(spark):
    """A stage called again does not take the tables of a result that is still unread, and runs at once keep to their own."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    halves = [docs.where(F.col("doc_id") % 2 == i) for i in (0, 1)]
    step = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    first, second = (step(spark, h, sf) for h in halves)
    want = [{r["doc_id"] for r in cut(step(spark, h, sf)).collect()} for h in halves]
    assert [{r["doc_id"] for r in df.collect()} for df in (second, first)] == want[::-1]
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: sorted(map(str, corpus_pipeline.run(spark, sf).collect())), range(2)))
    assert both[0] and both[0] == both[1]


def test_odd_rows_through_all_stages(spark):
    """Null, empty and repeated rows pass every stage that keeps documents, with the columns of documents."""
    sf = "/root/testdata/sf0.001"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "a b c"), (None, None), (5, "x " * 3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() == len(rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5, None}
    nothing = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name
