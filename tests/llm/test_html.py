import pyarrow.parquet as pq
import pytest

from marlstone.llm.html import extract, main_text

LONG = "A sentence of the article that goes on for a while, with words and more words. "


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain  words\nhere", "plain words here"), ("<script>x()</script>", ""), ("<p>a &amp; b&nbsp;&#233;", "a & b é")])
def test_small_pages(html, text):
    assert main_text(html) == text


def test_article_without_its_surroundings():
    body = f"<h1>Head</h1><p><b>{LONG}<br><p>{LONG}</p><p>Short.</p><ul><li>one<li>two</ul>"
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<header><a href="/">Site</a></header><nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice">We use cookies and more cookies on this site.</div>'
        f'<article class="post"><header class="entry-header"><h2>Kicker</h2></header>{body}<aside>Aside</aside><div class="ad">Buy this now</div><form><label>Mail</label><input></form>'
        f'<section id="comments"><p>{LONG * 3}</p></section></article>'
        f'<div class="sidebar"><p>{LONG}</p></div><footer>&copy; 2020</footer></body></html>'
    )
    want = f"Kicker Head {LONG.strip()} {LONG.strip()} Short. one two"
    assert main_text(page) == want


def test_page_without_semantic_elements():
    page = '<body><div class="menu"><a>x</a><a>y</a></div>' + "".join(f"<div><p>{LONG}{i}</p></div>" for i in range(5)) + '<div class="footer">end</div>'
    assert main_text(page) == " ".join(f"{LONG}{i}" for i in range(5))


def test_short_blocks_in_the_middle_of_a_page_without_article():
    paragraphs = [f"{LONG * 5}{i}" for i in range(18)]
    items = [f"An item of the list, no {i:02}" for i in range(20)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs[:10]) + "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" + "".join(f"<p>{p}</p>" for p in paragraphs[10:])
    page = f'<body><nav><a>Menu</a></nav><div class="post"><h1>Head</h1>{body}</div><div class="footer">end</div></body>'
    assert main_text(page) == " ".join(["Head", *paragraphs[:10], *items, *paragraphs[10:]])


def test_all_sibling_articles():
    page = f"<body><nav><a>Menu</a></nav><article><p>{LONG * 3}</p></article><article><p>Short.</p></article><article><p>{LONG}</p></article><footer>end</footer></body>"
    assert main_text(page) == f"{LONG * 3}Short. {LONG.strip()}"


def test_small_article_before_the_text():
    page = f"<body><article><p>A teaser.</p></article>{''.join(f'<p>{LONG}{i}</p>' for i in range(9))}</body>"
    assert main_text(page) == "A teaser. " + " ".join(f"{LONG}{i}" for i in range(9))


@pytest.mark.parametrize("name", ['class="related-work"', 'class="social-history"', 'id="notice-of-race"', 'class="side-effects intro"'])
def test_names_of_sections_inside_an_article(name):
    page = f"<body><nav><a>Menu</a></nav><article><h1>Head</h1><p>{LONG * 3}</p><section {name}><h2>Part</h2><p>{LONG}</p></section><div class='related-posts'><p>{LONG * 2}</p></div></article></body>"
    assert main_text(page) == f"Head {LONG * 3}Part {LONG.strip()}"


@pytest.mark.parametrize("wrapper", ["form", 'div class="page-header-menu-layout"', 'div id="sidebar-left"'])
def test_marked_wrappers_of_the_whole_page(wrapper):
    body = f"<h1>Head</h1><p>{LONG * 3}</p><p>{LONG}</p>"
    for inner in (body, f"<article>{body}</article>"):
        page = f"<body><{wrapper}><nav><a>Menu</a></nav>{inner}<div class='ad'><p>Buy</p></div></{wrapper.split()[0]}></body>"
        assert main_text(page) == f"Head {LONG * 3}{LONG.strip()}"


def test_links_between_two_clusters():
    links = "".join(f'<p><a href="/{i}">l{i}</a> <a>x</a> <a>y</a></p>' for i in range(30))
    page = f"<body><article><p>{LONG * 5}</p>{links}<p>{LONG * 4}</p></article></body>"
    assert main_text(page).startswith(LONG * 5) and main_text(page).endswith((LONG * 4).strip()) and "l15 x y" in main_text(page)


def test_smoothing_and_threshold_select():
    short = "".join(f"<li><a>go {i}</a>" for i in range(12))
    page = f"<body><ul>{short}</ul><p>{LONG * 4}</p><p>{LONG * 5}</p><ul>{short}</ul></body>"
    assert main_text(page, sigma=0.5, threshold=2.0) == (LONG * 9).strip()
    assert "go 11" in main_text(page, threshold=0.0) and len(main_text(page, sigma=8.0)) > len(main_text(page, sigma=0.5, threshold=2.0))


def test_given_pages_with_div_for_article():
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        assert main_text(row["html"].replace("<article>", "<div>").replace("</article>", "</div>")) == main_text(row["html"])


def test_deep_nesting_is_linear():
    page = "<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000 + f"<p>{LONG}" + "</i>" * 50_000 + "<div class=ad>" * 20_000 + "x" + "</div>" * 20_000 + LONG
    assert main_text(page) == (LONG * 2).strip()


def test_inline_tags_do_not_part_words():
    assert main_text("<p>wo<b>rd</b> an<i>d</i>\n <a href=x>link</a>ed</p>") == "word and linked"


def test_crossed_and_unclosed_tags():
    assert main_text("<article><p><b>one<p>two</b></div><p>three") == "one two three"


def test_table_with_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(extract(df).collect(), key=str)
    assert sorted(((r["page_id"], r["url"], r["n_chars"]) for r in got), key=str) == sorted([(1, "u", 1), (1, "u", 1), (2, None, 0), (None, "v", 0), (3, "w", 249_999)], key=str)
    assert extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and extract(df.limit(0)).count() == 0


def test_given_pages():
    import html
    import re

    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        assert main_text(row["html"]) == " ".join(html.unescape(plain).split())
