import html as H
import re

import pytest

from refrain.llm.html_text import extract, main_text, op7_html_main_text

LONG = "The quick brown fox jumps over the lazy dog, again and again, until evening comes. " * 4


def brute(page):
    """Blocks of the one article element of the test tables' pages."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    texts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_equals_brute_force_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op7_html_main_text(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == brute(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page,expected",
    [
        ("", ""),
        ("no tags at all", "no tags at all"),
        (f"<body><div id=menu>Home</div><div class=content><h2>T</h2><p>{LONG}</p><p>Be.</p><p>{LONG}</p></div><div class='side-bar sidebar'>Links and more</div></body>", f"T\n{LONG.strip()}\nBe.\n{LONG.strip()}"),
        (f"<main><article><h1>A &amp; B</h1><p>x  y\n z<br>w</p><div class=comments><p>{LONG}</p></div><aside>{LONG}</aside><p>{LONG}</p></article></main>", f"A & B\nx y z w\n{LONG.strip()}"),
        (f"<article><p>{LONG}<p>two<ul><li>a<li>b</ul><form><p>{LONG}</p></form></article><footer>{LONG}</footer>", f"{LONG.strip()}\ntwo\na\nb"),
        (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}", LONG.strip()),
        ("<article><p>&lt;b&gt; &#8364; &eacute;<script>var a='<p>no</p>'</script></p></article>", "<b> € é"),
    ],
)
def test_pages(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<body><h1>Title</h1><p>{LONG * 9}</p><p>Short end.</p></body>", f"Title\n{(LONG * 9).strip()}\nShort end."),
        (f"<body><h1>Title</h1><div><p>{LONG * 9}</p><p>{LONG * 9}</p></div><p>Short end.</p></body>", f"Title\n{(LONG * 9).strip()}\n{(LONG * 9).strip()}\nShort end."),
        (f"<body><h1>Title</h1><ul><li>{LONG * 9}</ul><p>Short end.</p></body>", f"Title\n{(LONG * 9).strip()}\nShort end."),
        (f"<body><table><tr><td><p>{LONG}</p><p>Be.</p></td></tr></table></body>", f"{LONG.strip()}\nBe."),
        (f"<body><h1>Title</h1><h2>By</h2><h3>On</h3><div>{'<p>' + LONG + '</p>'}{('<p>' + LONG * 9 + '</p>') * 4}</div></body>", "\n".join(["Title", "By", "On", LONG.strip(), *[(LONG * 9).strip()] * 4])),
    ],
)
def test_no_block_beside_the_largest_is_lost(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<article class='post comments-open'><p>{LONG}</p><p>Be.</p></article>", f"{LONG.strip()}\nBe."),
        (f"<div class='content has-sidebar'><p>{LONG}</p><p>Be.</p></div><div class=sidebar>{LONG}</div>", f"{LONG.strip()}\nBe."),
        (f"<main id='no-sidebar'><p>{LONG}</p></main>", LONG.strip()),
        (f"<main class='sharing'><p>{LONG}</p><div class=share>Send</div></main>", LONG.strip()),
        (f"<div class='share-container'><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div class=related>More</div></div>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<div class='share-container'><article><p>{LONG}</p></article></div>", LONG.strip()),
        (f"<article><h1>T</h1><div class='share-container'><p>{LONG}</p></div></article>", f"T\n{LONG.strip()}"),
        (f"<article class='social-science'><p>{LONG}</p></article>", LONG.strip()),
        (f"<main><div id='notice-of-appeal'><p>{LONG}</p></div></main>", LONG.strip()),
        (f"<article><p>{LONG}</p><section class='share-prices'><p>Up by two.</p></section><section id=relatedWork><p>{LONG}</p></section></article>", f"{LONG.strip()}\nUp by two.\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div class='share-buttons'>Send</div><div class='ad-300x250'>Buy</div><ol class=commentList><li><p>{LONG}</p></ol></article>", LONG.strip()),
        (f"<body><div class=story><h1>T</h1><p>{LONG}</p><p>Be.</p></div><section class='newsletter-signup'>Join</section><div id='comments-area'><p>{LONG}</p></div></body>", f"T\n{LONG.strip()}\nBe."),
        (f"<article><p>Be.</p></article><div class=ad>{LONG}</div>", "Be."),
        (f"<article></article><div class=ad>{LONG}</div>", ""),
        (f"<article><p>{LONG}</p></article><div id=comments><p>{LONG * 5}</p><p>{LONG * 5}</p></div>", LONG.strip()),
        (f"<article><p>{LONG}</p><div class=comments><p>{LONG * 5}</p></div></article>", LONG.strip()),
    ],
)
def test_wrappers_with_hint_words_keep_their_text(page, expected):
    assert main_text(page) == expected


def test_nulls_repeats_and_broken_markup(spark):
    rows = [(1, "u", None, 5), (None, None, "<article><p>x</p></article>", 6), (2, "u", "<p" * 3000, 7), (2, "u", "</div>" * 500 + "<article>ok", 8), (3, "u", "<div>" * 5000 + "deep", 9)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got if r["page_id"] != 2) == [(0, "x"), (1, ""), (3, "deep")]
    assert "ok" in [r["text"] for r in got if r["page_id"] == 2]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
