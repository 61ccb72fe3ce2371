from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from braid.llm import exact, registry
from braid.llm.common import one_space


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[3], best[3], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def shown(frame):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in frame.collect()), key=repr)


def test_odd_rows(odd_docs):
    found = exact.dedup_exact(odd_docs)
    assert shown(found) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found.where("kept").select("text_sha256").distinct().count() == found.where("kept").count()


def test_documents(documents, texts):
    assert shown(exact.dedup_exact(documents)) == brute(texts.items())


def test_collisions_are_told_apart(odd_docs):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1).substr(1, 1))  # noqa: E731  half a byte
    good, poor = exact.dedup_exact(odd_docs), exact.dedup_exact(odd_docs, digest=weak)
    key = lambda f: sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in f.collect()), key=repr)
    assert key(good) == key(poor)
    assert poor.where("kept").count() == good.where("kept").count()


def test_empty(no_docs):
    assert exact.dedup_exact(no_docs).isEmpty()


def flushed(spark, index, rows):
    index.flush(spark.createDataFrame(rows, "doc_id bigint, text string"))


def held(rows):
    return {r["id"]: r["n"] for r in rows.collect()}


def test_index_merges_batches(spark):
    index = exact.DigestIndex(spark)
    for batch, counts in (([(5, "a"), (6, "b")], {5: 1, 6: 1}), ([(2, "a"), (9, "c")], {2: 2, 6: 1, 9: 1}), ([(1, "c"), (7, "c"), (8, "d")], {2: 2, 6: 1, 1: 3, 8: 1})):
        flushed(spark, index, batch)
        assert held(index.compact()) == counts
    assert len(index.runs) == 1 and len(index.retired) == 5
    index.drop_retired()
    assert held(index.lookup(index.read(*index.runs))) == {2: 2, 6: 1, 1: 3, 8: 1}


def test_levels_fill_and_lookups_see_every_live_run(spark):
    index, rows = exact.DigestIndex(spark, memtable=2, fanout=2), []
    for k in range(5):
        batch = [(100 - 10 * k + j, "text %d" % (j % (k + 2))) for j in range(7)]
        rows += batch
        flushed(spark, index, batch)
        if k == 2:
            index.compact()
    assert [len(level) for level in index.levels].count(0) >= 1 and 2 <= len(index.runs) <= 3
    keys = spark.createDataFrame([(f"text {j}",) for j in (0, 1, 5, 9)], "text string").select(index.digest(F.col("text")).alias("digest"))
    expected = {}
    for i, text in rows:
        if text in ("text 0", "text 1", "text 5"):
            least, n = expected.get(text, (i, 0))
            expected[text] = (min(least, i), n + 1)
    assert held(index.lookup(keys)) == dict(expected.values())


def test_one_space(spark):
    text = "a \t\x0b b\r\n\x0c\x0cc   d  \x1c e"
    assert spark.range(1).select(one_space(F.lit(text))).first()[0] == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_sql_is_registered():
    assert "op9_exact_dedup" in registry.oracle_sql()
