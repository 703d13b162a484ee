"""op4: a host's wrapper is made of all its pages, whatever slots and splits they fall in."""

from sqlsift.llm import html_extract


def test_template_of_few_pages_of_a_large_host(spark, monkeypatch):
    # a fixed text on 6 of 400 pages, and a line that 40 articles share: the one is template, the other is not
    def page(k):
        promo = "<div class=offer>Fixed offer</div>" if k % 71 == 5 else ""
        shared = "<p>A line that articles share</p>" if k % 10 == 3 else ""
        return f"<body><div class=t>Fixed words</div>{promo}<article>{shared}<p>own text {k}</p>{'<p>more</p>' * (k % 7)}<div class=offer2>{'Fixed end' if k % 71 == 6 else k}</div></article>{promo}</body>".replace("<article>", "<div class=a>").replace("</article>", "</div>")

    pages = {k: page(k) for k in range(400)}
    want = {k: "\n".join((["A line that articles share"] if k % 10 == 3 else []) + [f"own text {k}"] + ["more"] * (k % 7) + ["Fixed end" if k % 71 == 6 else str(k)]) for k in pages}
    wrapper = html_extract.induce(list(pages.values()))
    assert {k: html_extract.extract(p, wrapper) for k, p in pages.items()} == want
    df = spark.createDataFrame([(k, "http://w.example/", p) for k, p in pages.items()], "page_id long, url string, html string")
    for each, parts in ((512, 1), (40, 7)):
        monkeypatch.setattr(html_extract, "SLOT_PAGES", each)
        assert {r.page_id: r.text for r in html_extract.extract_pages(df.repartition(parts)).collect()} == want
