import random
from html import escape

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html

P = "<p>A paragraph of the story, with commas, and enough words to count for something here.</p>"
T = "A paragraph of the story, with commas, and enough words to count for something here."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple  text", "plain & simple text"),
        (f"<nav><a href=/>x</a></nav><article><h1>Head</h1>{P}{P}</article><footer>f</footer>", f"Head {T} {T}"),
        (f"<body><div id=menu><a>m</a></div><div class='post-body'>{P}<div class=ad>buy</div>{P}</div><div class=comments>{P}{P}{P}</div></body>", f"{T} {T}"),
        (f"<main><header>top</header><section>{P}</section><section><p>Short.</p></section><aside>{P}</aside><form>{P}</form></main>", f"{T} Short."),
        ("<article><p><b>One.<br><p>Two &eacute;&#33;&#x21;</p></article>", "One. Two é!!"),
        ("<article><p>a<b>b</b>c<script>var t='</p><p>x'</script>d<!-- <p>no --></p><style>p{}</style></article>", "abcd"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
        ("<article><p>1 < 2 and 3 > 2</p><p title='a>b' hidden>no</p><p style='display: none'>no</p><p>a\n\t b</article>", "1 < 2 and 3 > 2 a b"),
        ("<article><div class='cookie-notice'>c</div><p>x</p></p></div></article></body>", "x"),
        ("<article><p>open <a href='", "open"),
        ("<title>t</title><script>only()", ""),
        (f"<h1>Head</h1><article>{P}</article><section class=discussion>{P}{P}</section><section>{P}{P}</section>", f"Head {T}"),
        (f"<div id=page><div class=topnav>{P}</div><h1>Head</h1><div class=story>{P}{P}</div><div id=usercomments>{P}{P}{P}</div><p class=footer-note>{T}</p></div>", f"Head {T} {T}"),
        (f"<div class=cookieconsent>{P}</div><div><div>{P}<blockquote>Said.</blockquote></div></div><div role=complementary>{P}{P}</div>", f"{T} Said."),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_columns_and_depth(spark):
    deep = "<div>" * 50_000 + P + "</div>" * 50_000
    rows = [(1, None), (2, ""), (3, deep), (4, "<article>" + P * 2000 + "</article>")]
    got = [r.t for r in spark.createDataFrame(rows, "page_id long, html string").select(html.extract(F.col("html")).alias("t")).collect()]
    assert got == ["", "", T, " ".join([T] * 2000)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='product reviews'>{P}{P}</div>", f"{T} {T}"),
        (f"<div class='social-policy story'>{P}{P}</div><div class='social share'>{P}</div>", f"{T} {T}"),
        (f"<main><article>{P}</article><section>{P}</section><article>One.</article></main>", f"{T} {T} One."),
        (f"<article>{P}</article><div class=ad>buy</div><article>{P}</article><article>{P}</article>", f"{T} {T} {T}"),
        (f"<article>{P}{P}</article><section class=reviews>{P}{P}{P}</section>", f"{T} {T}"),
        (f"<article></article><section class=reviews>{P}</section>", ""),
        (f"<article>{P}</article><article><a href=/x>{T}</a></article>", T),
        (f"<div><div>{P}</div><div>{P}</div></div>", f"{T} {T}"),
    ],
)
def test_several_parts_and_doubtful_names(page, want):
    assert html.main_text(page) == want


def random_page(rnd):
    """A page with noise in all places, and the text of its article as it was put in."""
    word = lambda: "".join(rnd.choice("abcdefgéß&<") for _ in range(rnd.randint(1, 9)))
    kept = []

    def words(n):
        w = [word() + rnd.choice(["", "", ","]) for _ in range(n)]
        kept.append(" ".join(w))
        i = rnd.randrange(n)
        marks = ["<b>{}</b>", "<!-- no -->{}", "{}<script>if (a < b) '</p>'</script>", "<span title='a > b'>{}</span>", "{}"]
        return rnd.choice([" ", "\n\t "]).join(rnd.choice(marks).format(escape(x)) if j == i else escape(x) for j, x in enumerate(w))

    def block():
        kind = rnd.choice(["p", "p", "p", "h2", "blockquote", "ul", "table"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words(9)}" for _ in range(3)) + "</ul>"
        if kind == "table":
            return f"<table><tr><td>{words(6)}<td>{words(7)}</table>"
        return f"<{kind}>{words(rnd.randint(20, 60))}</{kind}>"

    def junk():
        text = ", ".join("junk" for _ in range(rnd.randint(1, 80)))
        return rnd.choice(["<nav><a href=/>{}</a></nav>", "<aside><p>{}</p></aside>", "<div class='ad-box'>{}</div>", "<div id=comments><p>{}</p></div>", "<form>{}</form>", "<style>{}</style>", "<div class='cookie-bar'>{}</div>", "<footer>{}</footer>", "<section class=reviews><p>{}</p></section>"]).format(text)

    some = lambda: "".join(junk() for _ in range(rnd.randint(0, 2)))
    part = lambda: "".join(block() + some() for _ in range(rnd.randint(3, 6)))
    shape = rnd.choice(["article", "articles", "main", "div"])
    body = {"article": lambda: f"<article>{part()}</article>", "articles": lambda: f"<article>{part()}</article>{some()}<article>{part()}</article>",
            "main": lambda: f"<main><article>{part()}</article>{some()}<section>{part()}</section></main>", "div": lambda: f"<div class=story>{part()}</div>"}[shape]()
    return f"<html><head><title>no</title></head><body>{some()}{body}{some()}</body></html>", " ".join(kept)


def test_random_pages():
    rnd = random.Random(31)
    for _ in range(400):
        page, want = random_page(rnd)
        assert html.main_text(page) == want, page


def test_empty_table_repeats_and_other_columns(spark):
    schema = "page_id long, html string, text string, n_chars string, points int"
    rows = [(1, f"<article>{P}</article>", "x", "y", 1)] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumn("main", html.extract(F.col("html")))
    got = sorted((r.main, r.text or "", r.n_chars or "") for r in df.collect())
    assert got == [("", "", ""), (T, "x", "y"), (T, "x", "y")]
    assert df.where("false").count() == 0


@pytest.mark.parametrize(
    "wrapper",
    [
        "div class='layout has-sidebar'", "div id='page' class='no-sidebar'", "div class='article ad-free'", "div class='post comment-count-3'", "div class='recipe cookies'", "div class='hidden-gems'",
        "form action='/page.aspx'", "div class='content-with-menu'", "section class='widget'", "div class='nav-layout'", "div id='footer-wrap'",
    ],
)
@pytest.mark.parametrize("inner", ["{p}{p}", "<article>{p}{p}</article>", "<div class='has-menu'><div>{p}{p}</div></div>"])
def test_no_name_drops_the_only_text(wrapper, inner):
    page = f"<body><div class=ad>buy</div><{wrapper}>{inner.format(p=P)}<div class=sidebar>{P}</div></{wrapper.split()[0]}><div id=comments>{P * 5}</div></body>"
    assert html.main_text(page) == f"{T} {T}"


def test_readers_comments_alone_are_no_article():
    assert html.main_text(f"<body><h1>Head</h1><div id=comments>{P * 5}</div></body>") in ("", "Head")
    assert html.main_text(f"<body><div class=ad>{P}</div><div>{P}{P}</div></body>") == f"{T} {T}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div id=w><div>{P * 4}</div><h3>Sub</h3><p>Tiny.</p><ul><li>One</li><li>two</li></ul></div>", " ".join([T] * 4) + " Sub Tiny. One two"),
        (f"<div id=w><div>{P * 4}</div><div><p>Short end.</p></div><div><a href=/>more</a></div></div>", " ".join([T] * 4) + " Short end."),
        (f"<article><header><div><h1>Head</h1><p>by me</p></div></header>{P}</article>", f"Head {T}"),
        (f"<article><header><nav><h1>Menu</h1></nav></header>{P}</article>", T),
        (f"<header><h1>Site</h1></header><article>{P}</article>", T),
    ],
)
def test_tails_and_titles_are_kept(page, want):
    assert html.main_text(page) == want


def test_deep_marked_wrappers_stay_linear():
    page = "<div class='has-menu'>" * 20_000 + P + "</div>" * 20_000
    assert html.main_text(page) == T
