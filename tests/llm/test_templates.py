"""Site templates on short pages, and on hosts with several types of pages."""

from weft.llm import html


def texts(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_short_pages_lose_their_templates(spark):
    teaser = f"<div class='box2'><p>{'Read more of our stories every day. ' * 3}</p></div>"
    pages = [(f"http://a.example/{i}", f"<body><p>Short news {i}</p>{teaser}</body>") for i in range(40)]
    stubs = [("http://a.example/stub", f"<body>{teaser}</body>")]
    copies = [("http://b.example/x", "<body><div><p>One page that was stored many times</p></div></body>")] * 30
    assert texts(spark, pages + stubs + copies) == [f"Short news {i}" for i in range(40)] + [""] + ["One page that was stored many times"] * 30


def test_templates_of_page_groups(spark):
    own = lambda i: f"<div><p>Item {i} tells of its own matter at some length</p></div>"
    want = lambda i: f"Item {i} tells of its own matter at some length"
    by_layout = [(f"http://c.example/{i}", f"<body>{own(i)}<div class='box{'ab'[i % 2]}'><p>Teaser of type {i % 2}</p></div></body>") for i in range(60)]
    by_section = [(f"http://d.example/{'news' if i % 3 else 'blog'}/{i}", f"<body>{own(i)}<p>Filed under {'news' if i % 3 else 'blog'}</p></body>") for i in range(90)]
    rare = [(f"http://e.example/{i}", f"<body>{own(i)}<p>{'Rain today' if i % 3 == 0 else i}</p></body>") for i in range(60)]
    assert texts(spark, by_layout + by_section) == [want(i) for i in range(60)] + [want(i) for i in range(90)]
    assert texts(spark, rare)[0] == f"{want(0)}\nRain today"
