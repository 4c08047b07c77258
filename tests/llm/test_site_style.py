from tidemark.llm import site_style as S


def test_pages(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>A &amp; b</h1><p><b>One\n two<br><p>Three<em>four</em>.</article><footer>&copy; x</footer></body></html>'
    rows = [(1, "http://a.x/1", page), (2, None, None), (3, "bad", ""), (4, "http://a.x/2", page)]
    rows += [(10 + i, f"http://b.x/{i}", f"<body><div class=top>Welcome here</div><div class=c><p>Text {i} of it</p></div></body>") for i in range(12)]
    rows += [(30 + i, "http://c.x/", "<div>Same</div>") for i in range(12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in S.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[1].text == got[4].text == "A & b\n\nOne two\n\nThreefour."
    assert got[2].text == got[3].text == "" and got[2].url is None
    assert all(got[10 + i].text == f"Text {i} of it" for i in range(12))
    assert all(got[30 + i].text == "Same" for i in range(12))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_empty(spark):
    assert S.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_importance_decides_inside_article_and_beside_it(spark):
    rows = [(i, f"http://a.x/{i}", f"<body><article><div class=k>Read our guide</div><p>Text {i} of it</p></article></body>") for i in range(9)]
    rows += [(20 + i, f"http://b.x/{i}", f"<body><article><p>Teaser {i}</p></article><div class=body>Long text {i}</div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {i} of it" for i in range(9))
    assert all(got[20 + i] == f"Teaser {i}\n\nLong text {i}" for i in range(9))


def test_hosts_of_two_pages(spark):
    rows = [(i, f"http://a.x/{i}", f"<body><div class=top>Welcome here</div><div class=k><p>All</p><p>Our</p></div><div class=c><p>Text {i}</p></div></body>") for i in range(2)]
    rows += [(5, "http://b.x/", "<body><ul class=u><li>Same</li><li>Same</li></ul><p>Alone</p></body>")]
    got = {r.page_id: r.text for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Text 0", 1: "Text 1", 5: "Same\n\nSame\n\nAlone"}
