import html as h

import pyarrow.parquet as pq
import pytest

from gridtide.llm.extract import content_lines, extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies and more cookies than anybody ever would need.</div>
<div class="ad">Buy &amp; buy</div>%s
<aside>Side bar text</aside><form><label>Mail</label><input></form>
<section id="comments"><p>Great   article, I read it with pleasure and will read it again.</p></section>
<footer>&copy; me</footer></body></html>"""
BODY = """<h1>Head  line</h1><p>A <b>bold</b>er first paragraph &eacute;&#233; with\n enough words to be text.</p>
<p>Yes.<p>Second paragraph, <a href="x">linked</a> words<br>and a break.</p><ul><li>point one</li><li>two</li></ul>"""
WANT = (
    "Head line A bolder first paragraph éé with enough words to be text. Yes. Second paragraph, linked words and a "
    "break. point one two"
)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_article_is_found_whole(tag):
    assert main_text(PAGE % f"<{tag}>{BODY}</{tag}>") == WANT


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("just  text") == "just text"
    assert main_text("a < b &am &amp") == "a < b &am &"
    assert main_text("<p>cut <b>off") == "cut off"
    assert main_text("<article><p>" + "x " * 200000) == ("x " * 200000).strip()
    assert main_text("<b>" * 3000 + "deep") == "deep"


def test_clusters_follow_smoothed_ratios():
    import numpy as np

    got = content_lines(np.array([0, 1, 0, 1, 0, 90, 95, 5, 99, 80, 0, 1, 0.0]))
    assert got[5:10].all() and not got[:3].any() and not got[-2:].any()
    assert content_lines(np.array([4.0])).all()


def test_every_given_page_gives_its_article(spark):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r.row.page_id: r for r in extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for row in rows:
        inner = row["html"].partition("<article>")[2].partition("</article>")[0]
        for mark in ("<p>", "</p>", "<h1>", "</h1>", "<br>"):
            inner = inner.replace(mark, " ")
        want = " ".join(h.unescape(inner.replace("<b>", "")).split())
        assert got[row["page_id"]].text == want and got[row["page_id"]].n_chars == len(want)


def test_clashing_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, "t", 3)], "page_id long, html string, text string, n_chars int")
    row = extract_text(pages).first()
    assert (row.text, row.n_chars, row.row.text, row.row.n_chars) == ("", 0, "t", 3)
    assert extract_text(pages.limit(0)).collect() == []


LONG = "word " * 600


@pytest.mark.parametrize(
    "body",
    [
        f"<div><h1>Title here</h1><p>Short lead.</p><p>{LONG}</p><p>Short end.</p></div>",
        f"<h1>Title here</h1><div><p>Short lead.</p><div><p>{LONG}</p><p>{LONG}</p></div><p>Short end.</p></div>",
        f"<article><h1>Title here</h1><p>Short lead.</p></article><article><p>{LONG}</p></article><article>Short end.</article>",
        f"<div><h1>Title here</h1><p>Short lead.</p><ul><li>{LONG}</li></ul><p>Short end.</p></div>",
    ],
)
def test_short_parts_stay(body):
    got = main_text(PAGE % body).split()
    assert [w for w in got if w != "word"] == ["Title", "here", "Short", "lead.", "Short", "end."]
    assert got.count("word") == body.count("word ")


PROSE = [f"Sentence number {k} of a report that goes on at some length about matters of weather and trade." for k in range(8)]
MENU = "<div>" + "".join(f'<a href="/{k}">Go {k}</a> ' for k in range(8)) + "</div>"
PLAIN = f"<html><body>{MENU}<div id='a'><h2>Report</h2>" + "".join(f"<p>{p}</p>" for p in PROSE) + "</div><div id='b'><span>Tag one</span><div>x</div><div>y</div></div></body></html>"


def test_clusters_choose_the_region(monkeypatch):
    import numpy as np

    from gridtide.llm import extract

    want = " ".join(["Report", *PROSE])
    assert main_text(PLAIN) == want
    rng = np.random.default_rng(1)
    others = []
    for _ in range(20):
        monkeypatch.setattr(extract, "content_lines", lambda r: rng.random(len(r)) < 0.2)
        others.append(main_text(PLAIN))
    assert any(o != want for o in others)
    monkeypatch.setattr(extract, "content_lines", lambda r: ~content_lines(r))
    assert main_text(PLAIN) != want


def test_title_and_lead_before_an_article_stay():
    page = f"<body><nav>Menu</nav><main><h1>Title</h1><p>Lead.</p><article><p>{PROSE[0]}</p><p>{PROSE[1]}</p></article></main><footer>f</footer></body>"
    assert main_text(page) == f"Title Lead. {PROSE[0]} {PROSE[1]}"


def test_names_count_as_a_whole():
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    assert main_text(f'<body><div class="social-sciences">{body}</div></body>') == " ".join(PROSE)
    page = f'<article><div class="article-header"><h1>Head</h1></div><section class="login-guide"><p>How to.</p></section>{body}</article>'
    assert main_text(page) == " ".join(["Head", "How to.", *PROSE])
    for name in ("site-header", "share-buttons", "cookie_notice", "post-comments", "ad-slot-3", "related posts"):
        assert main_text(f'<body><div>{body}</div><div class="{name}"><p>short</p></div></body>') == " ".join(PROSE), name
    assert main_text(f'<body><div>{body}</div><div id="comments">{body}</div></body>') == " ".join(PROSE)


def test_links_beside_the_text_go_and_links_within_stay():
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    text = " ".join(PROSE)
    assert main_text(f"<body><div>{MENU}{body}</div></body>") == text
    assert main_text(f"<body><div><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul>{body}</div></body>") == text
    assert main_text(f"<article>{body}<p><a>One</a> <a>Two</a> <a>Three</a></p></article>") == text + " One Two Three"
    assert main_text(f"<body><div>{body}<p><a>Source</a></p></div></body>") == text + " Source"


@pytest.mark.parametrize(
    "page",
    [
        "<div>word word " * 10000,
        "<div>" * 10000 + "<p>some words</p>" * 10000,
        "<b>" * 10000 + "<p>some words" * 10000,
        "<div><b>" * 10000 + "x</i></b>" * 10000,
        "<a><b>x</a>" * 10000,
    ],
)
def test_deep_pages_take_linear_time(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 2
