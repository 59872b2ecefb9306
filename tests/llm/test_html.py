import pytest

from steward.llm.html import extract, main_text

BODY = "A sentence, with commas, that is long enough to be taken for prose by any rule."


def page(inner, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{inner}</body></html>"


def test_article_without_the_rest():
    got = main_text(
        page(
            "<nav><ul><li><a href=x>Home</a></li></ul></nav><header>Site</header>"
            "<div class='ad'>Buy, now, please, all of it, and more.</div>"
            f"<article><h1>Title</h1><p>{BODY}<p>Short.</p><form><p>{BODY}</p></form>"
            f"<script>var t='</p>';</script><style>p{{}}</style><aside><p>{BODY}</p></aside></article>"
            f"<div id='comments'><p>{BODY}</p><p>{BODY}</p></div><div class='cookie-notice'>{BODY}</div>"
            "<footer>&copy; all</footer>"
        )
    )
    assert got == f"Title\n\n{BODY}\n\nShort."


def test_best_container_and_siblings():
    got = main_text(
        page(
            "<div id=menu><a href=1>One</a> <a href=2>Two</a></div>"
            f"<div class=main><div class=part><p>{BODY}</p><p>{BODY} More.</p></div><p>Between.</p>"
            f"<div class=part><p>{BODY} Then.</p></div><ul><li><a href=3>Elsewhere</a></li></ul></div>"
            "<div><p><a href=4>Linked, linked, linked text that is long.</a></p></div>"
        )
    )
    assert got == f"{BODY}\n\n{BODY} More.\n\nBetween.\n\n{BODY} Then."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a &amp; b &lt;c&gt; &#233; &eacute; &copy</p>", "a & b <c> é é ©"),
        ("<p>one\n\t two<br>three</p>", "one two three"),
        ("<p>a<b>b</b>c <i>d</i></p>", "abc d"),
        ("<article><p><b>First.<br><p>Second.</p></article>", "First.\n\nSecond."),
        ("<article><p>cut off in a t<a href='x", "cut off in a t"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
        ("<article><p>Line, one.</p><p>Line, one.</p></article>", "Line, one.\n\nLine, one."),
        ("</div></p></html><p>after</p>", "after"),
        ("<nav>only a menu</nav>", ""),
        ("<article>bare text, in an article</article>", "bare text, in an article"),
        ('<article><p title="a > b">quoted</p><div hidden>no</div></article>', "quoted"),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


PARTS = [f"{BODY} Part {k}, of many." for k in range(4)]
PROSE = "".join(f"<p>{part}</p>" for part in PARTS)


@pytest.mark.parametrize(
    "inner",
    [
        f"<div id=page><div class='nav-bar'><a href=a>A</a></div><div class='post ad-free'>{PROSE}</div><div class=sidebar><p>{BODY}</p></div></div>",
        f"<div class=wrap><div class=story>{PROSE}</div><div class='related-posts'><p>{BODY}</p></div></div>",
        f"<section class=text>{PROSE}</section><section class='discussion'><p>{BODY}</p><p>{BODY}</p></section>",
        f"<table><tr><td class='left sidebar'><p>{BODY}</p></td><td class=body>{PROSE}</td></tr></table>",
        f"<div class=comments-off>{PROSE}</div><div id='user-comments'><p>{BODY}</p></div>",
        f"<div><div class=entry>{PROSE}</div><ul class=links><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>",
        f"<div class=entry>{''.join(f'<div>{part}</div>' for part in PARTS)}</div><div role=complementary><p>{BODY}</p></div>",
        f"<div class=entry>{PARTS[0]}<p>{PARTS[1]}</p><p>{PARTS[2]}</p><p>{PARTS[3]}</p></div><div class=cookie-notice>{BODY}</div>",
        f"<center>{PROSE}</center><div class=newsletter-signup><p>{BODY}</p><form><input></form></div>",
        f"<div class=a><div class=b><div class=c>{PROSE}</div></div></div><div class='site-footer'><p>{BODY}</p></div>",
    ],
)
def test_templates_without_article(inner):
    assert main_text(page(inner)) == "\n\n".join(PARTS)


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        (f"<article><h2 id='social-impact'>Impact</h2><section id='related-work'>{PROSE}</section></article>", ["Impact", *PARTS]),
        (f"<article><header><h1>Title</h1><nav><a href=x>x</a></nav></header>{PROSE}</article>", ["Title", *PARTS]),
        (f"<article>{PROSE}</article><section class=discussion><p>{BODY}</p></section>", PARTS),
        (f"<article><section id=discussion>{PROSE}</section></article>", PARTS),
        (f"<main><div class=text>{PROSE}</div><div class=box><h4>You may like</h4><a href=1>One, two</a> <a href=2>Three</a></div></main>", PARTS),
    ],
)
def test_names_alone_drop_no_prose(inner, want):
    assert main_text(page(inner)).split("\n\n") == want


def test_very_deep_and_long():
    assert main_text("<div>" * 20_000 + "deep text here") == "deep text here"
    long = f"<article>{''.join(f'<p>{BODY} {k}</p>' for k in range(5000))}</article>"
    assert main_text(long).count("\n\n") == 4999
    assert main_text("<p" * 20_000) == ""


def test_operator(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<p>{BODY}", "x", "y"), (1, "u", f"<p>{BODY}", "x", "y"), (None, None, None, None, None)]
    got = extract(spark.createDataFrame(rows, schema))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        map(repr, [(1, "u", BODY, len(BODY))] * 2 + [(None, None, "", 0)])
    )
    assert extract(spark.createDataFrame([], schema)).count() == 0


def test_pages_hold_their_documents(spark, sf):
    """Every page of the benchmark is an article in a frame; all its paragraphs are found."""
    import html as library
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = re.split(r"<(?:p|h1)[^>]*>|</(?:p|h1)>", inside)
        plain = (" ".join(library.unescape(re.sub(r"<br>", " ", b) and re.sub(r"<[^>]+>", " " if "<br>" in b else "", b)).split()) for b in blocks)
        assert main_text(r.html).split("\n\n") == [b for b in plain if b]
