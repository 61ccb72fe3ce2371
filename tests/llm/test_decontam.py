from __future__ import annotations

import random

from braid.llm import decontam


def distance_to_any_stretch(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(4)
    for _ in range(300):
        p, t = ([r.choice("abc") for _ in range(r.randrange(1, n))] for n in (12, 30))
        best, at = decontam.myers_search(p, t)
        assert best == distance_to_any_stretch(p, t)
        assert at == -1 or distance_to_any_stretch(p, t[: at + 1]) == best


def test_against_brute_force(spark, texts, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12)
    r = random.Random(9)
    bench = [(i["item_id"], i["text"]) for i in items.collect()]
    edited = []
    for k, (i, text) in enumerate(bench):  # planted with rising numbers of edits
        words = text.split()
        for j in r.sample(range(len(words)), min(len(words), k)):
            words[j] = r.choice(["changed", "", "two words"])
        edited.append((10**6 + i, f"{' '.join(list(texts.values())[k].split()[:60])} {' '.join(words)} end"))
    docs = documents.limit(60).select("doc_id", "text").union(spark.createDataFrame(edited, "doc_id bigint, text string"))
    found = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontam.leaks(docs, items).collect()}
    expected = {}
    for d in docs.collect():
        for i, text in bench:
            p = decontam.words_of(text)
            best = distance_to_any_stretch(p, decontam.words_of(d["text"]))
            if best <= len(p) // 5:
                expected[d["doc_id"], i] = best
    assert found == expected and len(found) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (None, "the quick brown fox jumps"), (4, "The QUICK, brown fox -- jumps over!"), (4, "The QUICK, brown fox -- jumps over!"), (5, "the quick brown fox jumps over")], "item_id bigint, text string")
    found = decontam.leaks(odd_docs, bench).collect()
    holds = [r["doc_id"] for r in odd_docs.collect() if "quick" in (r["text"] or "")]
    assert sorted(((r["doc_id"], r["item_id"], r["distance"], r["first_word"], r["last_word"]) for r in found), key=repr) == sorted([(7, 3, 0, 0, 0), *((d, i, 0, 0, 5) for d in holds for i in (4, 5))], key=repr)
    assert decontam.leaks(no_docs, bench).isEmpty() and decontam.leaks(odd_docs, bench.limit(0)).isEmpty()


def test_blocks_change_nothing(spark, documents, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.leaks(documents, bench).drop("text_hash").collect()))
    blocks = list(decontam.item_blocks(bench, 500))
    assert len(blocks) > 3 and sum(map(len, blocks)) == bench.count()
    split = sorted(m for b in blocks for r in documents.collect() for m in ((r["doc_id"], *x) for x in decontam.Matcher(b).matches(r["text"])))
    assert split == whole


def test_short_items_and_scripts_without_spaces():
    matcher = decontam.Matcher([(1, "two words"), (2, "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044")])
    assert matcher.matches("just Two words here") == [(1, 0, 1, 2)] and matcher.matches("two other words") == []
    assert matcher.matches("x \u4eca\u65e5\u306f\u96e8\u6c17\u304c\u3044\u3044\u3002") == [(2, 1, 1, 8)]
