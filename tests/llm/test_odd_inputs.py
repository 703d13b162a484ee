"""Very deep pages, parts of articles that look like page parts, and vectors of very large components."""

import math

from pyspark.sql import functions as F

from sqlsift.llm import common, html_extract, topk


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "text {}" + "</div>" * 5000
    pages = spark.createDataFrame([(k, "http://d.example/", "<div class=t>Fixed words</div>" + deep.format(k)) for k in range(4)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(pages).collect()} == {f"text {k}" for k in range(4)}


def test_packed_trees():
    tree = html_extract.bare(html_extract.parse("<div class=a>x<p>y</p><ul><li>1<li>2</ul></div><p>z"))
    assert html_extract.unpacked(html_extract.packed(tree)) == tree


def test_headers_and_formulas_of_articles():
    page = "<body><div class=header>Site</div><article><div class='entry-header'><h1>Title</h1></div><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><div class='share'>no</div></article></body>"
    assert html_extract.extract(page) == "Title\nso x=1."


def test_large_components(spark):
    rows = [(k, [1e30 if k == 3 else -1e300 if k == 4 else 1e5 + k, 0.5]) for k in range(8)]
    most = math.isqrt((1 << 62) // 2)
    vs = {k: [max(-most, min(most, math.floor(256 * x))) for x in v] for k, v in rows}
    got = {}
    for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (0, 2, 4, 6):
        want = sorted(((-sum(a * b for a, b in zip(vs[q], vs[c])), c) for c in vs if c != q))[:3]
        assert [got[q][i + 1] for i in range(3)] == [(c, -s) for s, c in want]


def test_names_decide_as_a_whole_only():
    page = "<body><div class='site-header'>Site</div><div class='share-buttons'>x</div>{}<div class='cookie-banner'>c</div></body>"
    inner = "<p>Intro words.</p><div class='share-price'><p>The share price rose.</p></div><p id='side-effects'>Few.</p><section id='search-algorithms'>Sort first.</section><div class='tags-and-tax'>Tax.</div><div class='header search'>Both.</div>"
    want = "Intro words.\nThe share price rose.\nFew.\nSort first.\nTax."
    assert html_extract.extract(page.format(f"<article>{inner}<div class='ad'>no</div><div class='comments'><p>no</p></div></article>")) == want + "\nBoth."
    assert html_extract.extract(page.format(inner)) == want
    chapters = "<ul><li><a href='#one'>Chapter one</a><li><a href='#two'>Chapter two</a></ul><ul><li><a href='/other'>Other page</a></ul><p>Text.</p>"
    assert html_extract.extract(page.format(chapters)) == "Chapter one\nChapter two\nText."


def test_random_names_change_nothing_where_pages_repeat(spark):
    def pages(name):
        return [(k, "http://r.example/", f"<body><div class='{name('a')}'>Home About Contact</div><div class='{name('b')}'><p>Article {k} says {k * 7}.</p></div><div class='{name('c')}'>All rights kept</div></body>") for k in range(6)]

    got = [{r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(pages(name), "page_id long, url string, html string")).collect()} for name in (str, lambda x: f"q{ord(x)}z", lambda x: "same")]
    assert got[0] == got[1] == got[2] == {k: f"Article {k} says {k * 7}." for k in range(6)}


def test_html_of_odd_tables(spark):
    rows = [(1, "http://a/", None, "t", 5), (1, "http://a/", None, "t", 5), (2, None, "", "t", 5), (2, None, "<p>x</p>", "t", 5), (2, None, "<p>x</p>", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_pages(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"] and sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0)] * 3 + [("x", 1)] * 2
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_scores_of_odd_tables(spark):
    from sqlsift.llm import lm_score

    rows = [(k if k % 4 else None, t, "x", 1) for k, t in enumerate(["a b c", None, "", "a b c", "x " * 500, "é ß", "a b c", ""] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `a.b` int")
    got = lm_score.lm_scores(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 > 0).collect()
    assert len(got) == len(rows) and all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert len({(r.n_tokens, round(r.score, 9)) for r in got if r.n_tokens == 4}) == 1  # equal texts
    assert lm_score.lm_scores(docs.limit(0), F.lit(True)).count() == 0
    path = common.stored(docs.select("doc_id", "text"), "same").inputFiles()[0].rsplit("/", 1)[0]
    again = spark.read.parquet(path).select("doc_id", "text", F.col("_metadata.row_index").alias("row"))
    told = lm_score.lm_scores(again, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 > 0, row_col="row").collect()
    assert sorted(map(repr, told)) == sorted(map(repr, got))


def test_vectors_of_odd_tables(spark):
    rows = [(k, v, "q", k) for k, v in [(0, [1.0, 2.0]), (2, [1.0, 2.0]), (4, None), (None, [9.0]), (6, [1.0, float("nan")]), (8, []), (3, [5.0, None]), (5, [2.0])]]
    df = spark.createDataFrame(rows, "VEC_ID long, embedding array<double>, query string, id long")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 2 == 0, k=2).collect())
    assert got == [(0, 1, 2, 5 << 16), (0, 2, 5, 2 << 16), (2, 1, 0, 5 << 16), (2, 2, 5, 2 << 16), (8, 1, 0, 0), (8, 2, 2, 0)]
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0


def test_dialogues_of_odd_tables(spark):
    from sqlsift.llm import chat

    rows = [(1, 0, "ann", "hi", "z", 1), (1, 1, "bob", None, "z", 2), (1, 1, "bob", None, "z", 3), (None, None, None, "x", "z", 4), (2, 0, "system", "s", "z", 5)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, message string, seq int"))
    assert sorted((r.conv_id, r.perspective, r.seq, r.kind) for r in got.collect()) == [(1, p, k, "assistant" if (p == "ann") == (k == 1) else "user") for p in ("ann", "bob") for k in (1, 2, 3)]
    assert chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, message string, seq int").limit(0)).count() == 0


def test_stored_tables_go_with_their_owner(spark):
    import os

    paths = []

    def make():
        one = common.stored(spark.range(5), "one")
        paths.extend(one.inputFiles())
        return one.filter("id > 1")

    out, path = common.settled(spark, make, "two")
    assert sorted(r.id for r in out.collect()) == [2, 3, 4] and not any(os.path.exists(p.removeprefix("file://")) for p in paths) and path in out.inputFiles()[0]
    common.dropped(spark, path)
    assert common._MADE == []
