from __future__ import annotations

import html as entities
import re

import pytest

from braid.llm import html, registry


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words &amp; more", "plain words & more"),
        ("<nav>Menu</nav><article><h1>T</h1><p>a<b>b</b> c<br>d<p>e&nbsp;&eacute;</article><footer>f</footer>", "T\nab c d\ne é"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><div class='comments'><p>no</p></div></article>", "T\nx"),
        ("<nav><ul><li>open menu<article><p>text</p></article>", "text"),
        ("<script>var t='</p><article>no';</script><style>p{}</style><p>yes</p><div class=ad>no</div><div id=cookie-notice>no</div>", "yes"),
        ("<article></article><p>loose</p>", ""),
        ("<!-- no --><article><p>one</p><form><input value=x><label>no</label></form><p>two <!-- no -->end</article>", "one\ntwo end"),
        ("<header>no</header><main><p>a</p><div class='loading'>b</div></main>", "a\nb"),
        ("<p>unclosed <b>bold<p>next &am &quot", "unclosed bold\nnext &am \""),
        ("<article><p>a</p><div class='related-work'><p>b</p></div><div class='share-price-analysis'>c</div><div id='no-ads'>d</div></article>", "a\nb\nc\nd"),
        ("<div class='content with-sidebar'><p>a</p><div class='left sidebar'>no</div></div>", "a"),
        ("<main><h1>T</h1><article>the article itself</article><article>comment</article></main>", "T\nthe article itself"),
        ("<article><p>the article itself</p><article>comment</article></article>", "the article itself"),
        ("<textarea><article>fake</article></textarea><p>real", "real"),
    ],
)
def test_blocks(page, text):
    assert "\n".join(html.blocks_of(page)[1]) == text


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        expected = "\n".join(x for p in parts if (x := " ".join(entities.unescape(p).split())))
        assert found[r["page_id"]]["text"] == expected and found[r["page_id"]]["n_chars"] == len(expected)


def brute(pages, run, structure=True):
    """Blocks without the tokens that any stretch of ``run`` shares with another page of the host, or whole blocks in articles."""
    host = lambda u: re.sub(r"https?://([^/]*).*", r"\1", u or "")
    parsed = {i: html.blocks_of(page, structure) for i, _, page in pages}
    urls = {i: host(url) for i, url, _ in pages}
    words = {i: " ".join(b).split() for i, (_, b) in parsed.items()}

    def sharing(i, has):
        return {tuple(words[j]) for j in parsed if urls[j] == urls[i] and parsed[j][0] == parsed[i][0] and has(j)}

    out = {}
    for i, (marked, blocks) in parsed.items():
        if marked:
            streams = {tuple(words[j]) for j in parsed if urls[j] == urls[i]}
            n = [len(sharing(i, lambda j: b in parsed[j][1])) for b in blocks]
            out[i] = "\n".join(b for b, k in zip(blocks, n) if k < html.MOST or 2 * k < len(streams))
            continue
        w = words[i]
        stretches = [tuple(w[k : k + run]) for k in range(len(w) - run + 1)]
        n = [len(sharing(i, lambda j: any(tuple(words[j][k : k + run]) == s for k in range(len(words[j]) - run + 1)))) for s in stretches]
        gone, many = ({k + x for k, c in enumerate(n) if c >= least for x in range(run)} for least in (2, html.MOST))
        if 2 * len(gone) > len(w):
            gone = many if len(many) < len(w) else set()
        at, kept = 0, []
        for b in blocks:
            kept.append(" ".join(x for j, x in enumerate(b.split()) if at + j not in gone))
            at += len(b.split())
        out[i] = "\n".join(k for k in kept if k)
    return out


def test_repeated_substrings_go(spark):
    top, end = "This site of ours uses many small cookies to serve you well", "All rights are reserved by the owners of this very page since 1999"
    pages = [(i, f"http://h{i % 2}.example/{i}", f"<div>{top}</div><p>Own text number {i} {'abcdefgh'[i]} stays here whole</p><p>tail {i} {end}</p>") for i in range(6)]
    pages += [(20, "http://h0.example/x", ""), (21, None, f"<p>{top}</p>")]
    mirrored = "<p>A whole article that stands under two addresses of one host and is no boilerplate</p>"
    pages += [(30, "http://h2.example/a", mirrored), (31, "http://h2.example/b", mirrored), (32, "http://h2.example/c", mirrored + "<p>and a tail</p>"), (33, "http://h2.example/d", "<p>other</p>")]
    notice = "<p>Please share this article with all of your friends</p>"
    pages += [(40 + i, "http://h3.example/%d" % i, f"<article><p>Text {i} of its own</p>{notice}<p>A quote that two of them share word by word {i // 2}</p></article>") for i in range(4)]
    rows = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert rows == brute(pages, html.RUN)
    assert rows[3] == "3 d stays here whole\ntail 3" and rows[21] == top
    assert rows[30] == rows[31] != "" and rows[32].startswith(rows[30])
    assert rows[41] == "Text 1 of its own\nA quote that two of them share word by word 0"


def test_repetition_alone_on_the_table(spark, sf_dir):
    """On the table's pages, all of which mark an article, the dealt method does the work once structure is left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    given = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    rows = {r["page_id"]: r["text"] for r in registry.queries()["op7_repetition"](spark, sf_dir).collect()}
    assert rows == brute(given, html.RUN, False)


def test_odd_rows(spark):
    schema = "page_id bigint, url string, html string, row int, keys string, text string, n_chars int"
    pages = [(1, "http://a/", "<article>x</article>", 1, "k", "t", 2), (1, "http://a/", "<article>x</article>", 1, "k", "t", 2), (None, None, None, None, None, None, None), (2**60 + 1, "::bad url", "<p>y</p>", 1, "k", "t", 2)]
    found = html.extract(spark.createDataFrame(pages, schema)).collect()
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in found), key=repr) == sorted([(1, "x", 1), (1, "x", 1), (None, "", 0), (2**60 + 1, "y", 1)], key=repr)
    assert html.extract(spark.createDataFrame([], schema)).isEmpty()
