from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from braid.llm import common, decontam, exact, quality, simhash


def test_stages_on_documents(spark, sf_dir, documents):
    """Each stage keeps what its operator does not reject, and the last lays out all that is left."""
    docs, labels = documents, spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for (name, stage), gone in zip(
        corpus_pipeline.STAGES[:-1],
        (
            lambda d: quality.classify(d, labels).where("predicted = 0"),
            lambda d: exact.dedup_exact(d).where("NOT kept"),
            lambda d: simhash.near_duplicates(d).where("doc_id <> component_id"),
            lambda d: decontam.leaks(d, bench),
        ),
    ):
        ids -= {r["doc_id"] for r in gone(docs).collect()}
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == documents.columns, name
        assert {r["doc_id"] for r in docs.collect()} == ids, name
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    names = odd_docs.columns
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd_docs, sf_dir)
        if name != "best-fit packing":
            assert found.columns == names
        found.count()
        assert stage(spark, no_docs, sf_dir).isEmpty()
    deduped = corpus_pipeline.exact_dedup(spark, odd_docs, sf_dir)
    assert deduped.where("doc_id = 6").count() == 0 and deduped.where("doc_id = 1").count() == 1
    twice = odd_docs.where("doc_id = 6")
    assert corpus_pipeline.exact_dedup(spark, twice, sf_dir).count() == 1


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(3, "x"), (5, "x"), (5, "unique"), (None, "x"), (None, "own text"), (None, item), (7, item), (7, "clean"), (8, near), (9, near + " end"), (9, "far"), (None, near + " fin"), (8, near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    shown = lambda f: sorted(map(tuple, f.collect()), key=repr)
    deduped = corpus_pipeline.exact_dedup(spark, docs, sf_dir)
    assert shown(deduped) == sorted([r for r in rows if r not in [(5, "x"), (None, "x"), (None, item), (8, near)]] + [(8, near)], key=repr)
    kept = corpus_pipeline.simhash_dedup(spark, deduped, sf_dir)
    assert shown(kept) == sorted([(3, "x"), (5, "unique"), (None, "own text"), (7, item), (7, "clean"), (8, near), (9, "far")], key=repr)
    assert (7, "clean") in shown(corpus_pipeline.decontaminate(spark, kept, sf_dir)) and (7, item) not in shown(corpus_pipeline.decontaminate(spark, kept, sf_dir))


def test_text_hashes_agree(spark):
    texts = ["", None, "a", "é x" * 50]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(common.text_hash_of(F.col("text"))).collect()] == [common.text_hash(t) for t in texts]


def test_small_decisions_are_shuffled_as_large_ones(spark):
    """The plan is the same at every size: a bitmap passes rows on, and the rest meet the decisions in a shuffle."""
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    gone = docs.where("doc_id IN (3, 5) OR text IN ('text 7', 'text 49')").select("doc_id", common.text_hash_of(F.col("text")).alias("text_hash"))
    left = corpus_pipeline._without(docs, gone)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [coalesce" not in plan
    assert sorted(r["text"] for r in left.collect()) == sorted(f"text {i}" for i in range(50) if i not in (3, 5, 7, 49))
