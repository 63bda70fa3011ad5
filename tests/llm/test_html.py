import re
from html import unescape

import numpy as np
import pytest

from vitalstream.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu a</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please agree to this very long notice of ours.</p></div>
<div class="ad">Buy this now, it is a long advert and goes on and on, really.</div>
<article><h1>Title &amp; more</h1><p><b>First</b> para  graph&nbsp;one with some words in it<br>and more.<p>Short.</p><aside>Aside text that is rather long and not in the article.</aside><p>x &lt; y, &copy; 5</p>
<section class="comments"><p>Reader comment which is long enough to look like content here.</p></section></article>
<form><p>Sign up</p><input type="text"></form><footer>&copy; example and a long footer text here, all rights reserved.</footer></body></html>"""
WANTED = "Title & more\nFirst para graph one with some words in it and more.\nShort.\nx < y, © 5"
PARAGRAPHS = "".join(f"<p>Paragraph {i} with a good number of words so that it looks like content to anyone.</p>" for i in range(8))


def test_article_only():
    assert html.main_text(PAGE) == WANTED


def test_without_article_element():
    menu = "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(30))
    page = f"<html><body><div id='top'><ul>{menu}</ul></div><div class='story'><h2>Head</h2>{PARAGRAPHS}</div><div class='footer'>foot</div></body></html>"
    got = html.main_text(page).split("\n")
    assert got[0] == "Head" and len(got) == 9


@pytest.mark.parametrize(
    "before, after",
    [
        ("<article class='post category-social'>", "</article>"),
        ("<div class='content has-sidebar'><article class='ad'>", "</article></div>"),
        ("<form action='/x'><div>", "</div></form>"),
        ("<div class='widget'><div>", "</div></div>"),
        ("<main><div class='address share'><article>", "</article></div></main>"),
    ],
)
def test_names_and_forms_around_the_article(before, after):
    page = f"<body><nav><ul><li><a href='/a'>One</a></li></ul></nav>{before}<h1>Head</h1>{PARAGRAPHS}{after}<div class='ad'>Buy it.</div></body>"
    got = html.main_text(page).split("\n")
    assert got[0] == "Head" and len(got) == 9


def test_parts_beside_long_paragraphs_join():
    page = f"<body><div class='story'><div><h2>Head</h2></div><div>{PARAGRAPHS}</div><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></div><div><a href='/1'>x</a> <ul><li><a href='/2'>next</a></li><li><a href='/3'>more</a></li><li><a href='/4'>top</a></li></ul></div></body>"
    got = html.main_text(page).split("\n")
    assert got[0] == "Head" and got[-3:] == ["one", "two", "a b"] and len(got) == 12


def test_articles_side_by_side():
    page = f"<body><div><article><p>{'Long text of the first. ' * 20}</p></article><article><p>Short.</p></article><div class='comments'><article class='comment'><p>{'I say. ' * 90}</p></article></div></div></body>"
    assert html.main_text(page).split("\n")[1:] == ["Short."]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text & no tags"), (4, "u", "<p>open <b>never closed <div class='ad'>x"), (5, "u", "<html></html>"), (5, "u", "<html></html>"), (None, "u", "<article><p>a</p></article>"), (6, "u", "<article>" + "<p>long text &eacute;</p>" * 20000 + "</article>"), (7, "u", "<script>never closed <p>x</p>"), (8, "u", "<div>" * 20000 + "deep" + "</span>" * 20000), (9, "u", "<nav>only a menu</nav>")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, text int, n_chars string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got[1] == got[2] == got[5] == got[7] == got[9] == ("", 0)
    assert got[3][0] == "just text & no tags" and got[4][0] == "open never closed" and got[None] == ("a", 1) and got[8] == ("deep", 4)
    assert got[6][0].count("\n") == 19999 and got[6][0].startswith("long text é\n")
    assert html.extract(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    """(html, text): in these pages everything between the article tags is the article."""
    out = []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h\d|div|ul|li|blockquote)\b[^>]*>", inner)
        texts = (" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
        out.append((r.html, "\n".join(t for t in texts if t)))
    return out


def test_corpus_articles(pages):
    assert all(html.main_text(page) == text for page, text in pages)


def test_article_tags_are_not_needed(pages):
    plain = [(re.sub(r"(</?)article>", r"\1div>", page), text) for page, text in pages]
    assert all(html.main_text(page) == text for page, text in plain)


@pytest.fixture(scope="module")
def neutral(pages):
    """The same pages without names: no class, id or role, and divisions for all semantic elements."""
    bare = lambda page: re.sub(r"(</?)(article|nav|footer|header|aside|main|section)\b", r"\1div", re.sub(r'\s(class|id|role)="[^"]*"', "", page))
    return [(bare(page), text) for page, text in pages]


def equal(pages):
    return sum(html.main_text(page) == text for page, text in pages) / len(pages)


def test_names_are_not_needed(neutral):
    assert equal(neutral) >= 0.9


@pytest.mark.parametrize(
    "what, change, most",
    [
        ("ratios", lambda of: lambda page: (of(page) > 0).astype(float), 0),
        ("ratios", lambda of: lambda page: (of(page) > 0) * np.random.default_rng(0).uniform(1, 200, len(page.lines)), 0.05),
        ("two_clusters", lambda of: lambda values: 0.0, 0),
        ("smoothed", lambda of: lambda page, values: values, 0.7),
    ],
)
def test_each_step_of_the_method_decides(neutral, monkeypatch, what, change, most):
    """Equal or random ratios, no threshold and no smoothing give other texts; zeros of markup stay where they are."""
    monkeypatch.setattr(html, what, change(getattr(html, what)))
    assert equal(neutral) <= most


def plainly(page):
    """The same for pages without nested parts or odd names, by a regular expression and loops over single lines."""
    page = re.sub(r"<!--.*?-->|<(script|style|title)\b.*?</\1>", "", page, flags=re.S)
    lines, text, tags, inside, linked, link = [], "", 0, [0], 0, False
    parent, boxes = [-1], 1
    for tag, close, name, words in re.findall(r"(<(/?)([a-zA-Z0-9!]+)[^>]*>)|([^<]+)", page):
        if words:
            text += words
            linked += len(words.strip()) if link else 0
            continue
        if name in ("p", "h1", "ul", "li", "div", "nav", "footer", "article", "body", "html", "head"):
            if t := " ".join(unescape(text).split()):
                lines.append((t, tags, inside[-1], min(linked, len(t)), {"nav", "footer", "*"} & {b for b in named[inside[-1]]} if inside[-1] else set()))
                tags = 0
            text, linked = "", 0
        elif name == "br":
            text += " "
        elif name == "a":
            link = not close
        tags += 1
        if name in ("nav", "footer", "div", "article", "ul", "head", "body"):
            if close:
                inside.pop()
            else:
                parent.append(inside[-1])
                named = {**(named if boxes > 1 else {0: ()}), boxes: (*(named[inside[-1]] if boxes > 1 else ()), name, "*" if 'class="ad"' in tag else "")}
                inside.append(boxes)
                boxes += 1
    value = [0.0 if barred else float(np.log1p((len(t) - 0.9 * n_link) / max(1, n))) for t, n, _, n_link, barred in lines]
    chain = lambda b: {b} if b <= 0 else {b} | chain(parent[b])
    smooth = []
    for i, (_, _, box, _, _) in enumerate(lines):
        near = [(j, np.exp(-((i - j) ** 2) / 8) * (1 if lines[j][2] in chain(box) or box in chain(lines[j][2]) else 0.25)) for j in range(max(0, i - 6), min(len(lines), i + 7)) if value[j]]
        smooth.append(sum(w * value[j] for j, w in near) / sum(w for _, w in near) if value[i] else 0.0)
    every = [*smooth, 0.0]
    low, high = min(every), max(every)
    for _ in range(50):
        a, b = [x for x in every if x < (low + high) / 2], [x for x in every if x >= (low + high) / 2]
        if a and b:
            low, high = sum(a) / len(a), sum(b) / len(b)
    cut = (low + high) / 2
    votes = {k: sum(s - cut for s, x in zip(smooth, lines) if k in chain(x[2])) for k in range(boxes)}
    best = max(votes, key=lambda k: (round(votes[k], 9), -k))
    return "\n".join(x[0] for x, s, v in zip(lines, smooth, value) if v and best in chain(x[2]) and s >= cut)


def test_agrees_with_a_plain_implementation(pages):
    for page, _ in pages:
        assert html.main_text(page) == plainly(page)


def test_a_page_of_content_only():
    short = "".join(f"<p>{'word ' * n}</p>" for n in (3, 40, 2, 9, 100, 4))
    assert html.main_text(short).count("\n") == 5


def test_clusters_and_smoothing():
    assert abs(html.two_clusters(np.array([0.0, 1, 2, 50, 51])) - 25.75) < 1e-9
    page = html.Lines()
    page.feed("<div><p>a<p>b<p>c</div><div><p>d</div>")
    page.end_line()
    assert np.allclose(html.smoothed(page, np.ones(4)), 1)
    got = html.smoothed(page, np.array([0.0, 2, 4, 8]))
    near, far = np.exp(-1 / 8), np.exp(-4 / 8)
    assert got[0] == 0 and abs(got[1] - (2 + near * 4 + far * 0.25 * 8) / (1 + near + far * 0.25)) < 1e-12
