from __future__ import annotations

import zlib

import numpy as np

from braid.llm import quality, registry

from .conftest import ids_of


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = registry.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98  # area under the curve


def test_rows_and_hold_out(odd_docs, spark):
    labels = spark.createDataFrame([(1, 1), (9, 0), (10, 0), (6, None), (None, 1), (8, 1), (8, 1), (7, 5)], "doc_id bigint, quality int")
    found = quality.classify(odd_docs, labels)
    assert ids_of(found) == ids_of(odd_docs)
    for r in found.collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_no_labels(odd_docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {round(r["score"], 9) for r in quality.classify(odd_docs, labels).collect()} == {0.5}


def test_empty(no_docs, spark):
    assert quality.classify(no_docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).isEmpty()


def test_scores_are_gaussian_log_densities():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(500, 3)), r.integers(0, 2, 500)
    x[y == 1] += 1
    n = np.array([(y == k).sum() for k in (0, 1)], float)
    total, cross = (np.stack([f(x[y == k]) for k in (0, 1)]) for f in (lambda a: a.sum(0), lambda a: a.T @ a))
    model = quality.from_sums(n, total, cross, 0.1, 1.0)
    logs = []
    pooled = sum(n[k] * np.cov(x[y == k].T, bias=True) for k in (0, 1)) / n.sum()
    for k in (0, 1):
        cov = 0.9 * np.cov(x[y == k].T, bias=True) + 0.1 * np.diag(np.diag(pooled))
        gap = x - x[y == k].mean(0)
        logs.append(np.log((n[k] + 1) / (n.sum() + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(logs[1] - logs[0]))))
