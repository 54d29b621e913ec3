import re

import pytest

from continuity.llm.maintext import INLINE, main_text, with_main_text

ARTICLE = "".join(f"<p>Paragraph {k} of the story, with words enough to be read as prose by all.</p>" for k in range(4))
STORY = "\n".join(f"Paragraph {k} of the story, with words enough to be read as prose by all." for k in range(4))
AROUND = [
    ('<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>', "nav"),
    ('<header class="top"><h1>Site</h1></header>', "header"),
    ("<footer>&copy; 2020 Example</footer>", "footer"),
    ('<aside><p>Related things to read next on this site.</p></aside>', "aside"),
    ('<div class="cookie-banner"><p>We use cookies to make this site better.</p></div>', "notice"),
    ('<div class="ad">Buy now, very cheap, only today in our shop.</div>', "advert"),
    ("<form><label>Search</label><input name=q></form>", "form"),
    ('<script>if (a < b) { document.write("<p>no</p>") }</script><style>p { margin: 0 }</style>', "script"),
    ('<section id="comments"><p>Reader: I liked this story a lot, thank you for writing it down.</p></section>', "comments"),
    ("<!-- a comment <p>not text</p> -->", "markup"),
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="a"><div id="b">{}</div></div>'])
def test_story_stays_and_everything_around_it_goes(wrap):
    before, after = AROUND[::2], AROUND[1::2]
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>%s%s%s</body></html>" % (
        "".join(x for x, _ in before), wrap.format(ARTICLE), "".join(x for x, _ in after)
    )
    assert main_text(page) == STORY


def test_blocks_white_space_and_references():
    page = "<body><article><h1>A &amp; B</h1><p>one\n two<br>three <b>f</b>our &lt;x&gt;&nbsp;y</p> tail <ul><li>i<li>j</ul></article>"
    assert main_text(page) == "A & B\none two three four <x> y\ntail\ni\nj"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- x", "<script>x", "<body></body>", "<div>" * 5000, "</p>" * 5000, "<table><td>x</table>", "<a <b> c", "<p title='x>y'>z"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_frame_keeps_its_rows(spark):
    rows = [(1, "u", None, "c"), (1, "u", "<p>x", "c"), (None, None, "", "c")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = with_main_text(df).collect()
    assert sorted(r.main_text for r in got) == ["", "", "x"]
    assert with_main_text(df.limit(0)).count() == 0
    assert not re.search("<", "".join(r.main_text for r in got))


@pytest.mark.parametrize("wrap", ["{}", "<main>{}</main>", "<div><div>{}</div></div>"])
def test_articles_side_by_side_all_stay(wrap):
    def paragraph(k):
        return f"sentence {k} of the story, long enough to count as text of the page. " * 3

    def article(name, numbers):
        return f"<article><h2>{name}</h2>" + "".join(f"<p>{paragraph(k)}</p>" for k in numbers) + "</article>"

    stories = article("One", range(4)) + article("Two", range(10, 14)) + article("Short", [20])
    teaser = "<article><a href='/x'>Another story that is told elsewhere</a></article>"
    page = f"<body><nav><a href='/'>home</a></nav>{wrap.format(stories + teaser)}<footer>f</footer></body>"
    lines = [x for n, r in (("One", range(4)), ("Two", range(10, 14)), ("Short", [20])) for x in (n, *(paragraph(k).strip() for k in r))]
    assert main_text(page) == "\n".join(lines)


LONG = "Words of a story that goes on for a while, as stories do. " * 12


@pytest.mark.parametrize(
    "page",
    [
        "<body><form action=x><div><h1>T</h1><p>{}</p><p>more of it</p></div></form></body>",
        "<body><form><article><p>{}</p></article></form></body>",
        '<body><div title="the hidden gem"><p>{}</p></div></body>',
        '<body><div data-url="/hidden/a"><p>{}</p></div></body>',
        '<body><main><div data-id="related"><p>{}</p></div><p>x y</p></main></body>',
        '<body><main><div data-role="banner"><p>{}</p></div><p>x y</p></main></body>',
        "<body><div alt='a class=\"ad\" b' title=id=menu><p>{}</p></div></body>",
        '<body><article class="share-post"><p>{}</p></article><article><p>One</p></article></body>',
        '<body><div class="sidebar layout"><p>{}</p></div><main><p>x</p></main></body>',
    ],
)
def test_containers_of_the_story_are_read(page):
    assert LONG.strip() in main_text(page.format(LONG))


def test_what_is_hidden_or_a_form_still_goes():
    page = '<body><div class=ad><p>Buy</p></div><div hidden><p>Not seen</p></div><form><label>Name</label><p>Give it</p></form><p>{}</p>'
    assert main_text(page.format(LONG)) == LONG.strip()
    assert main_text("<body><form><label>Name</label><input><button>Go</button></form></body>") == ""


def test_a_story_needs_no_article_element():
    """The same text under another name of its element, on all test pages."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pydict()["html"]
    for page in pages:
        assert main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page)) == main_text(page)


def test_equal_sums_are_both_taken():
    part = "<div>" + "<p>Words that are the same in both of them, here.</p>" * 3 + "</div>"
    assert main_text(f"<body>{part}{part}</body>").count("Words") == 6


def literal(page, out):
    """Density and density sum of every node from the definition, by walking down from it."""
    import html
    import math

    n = len(page.tag)
    below = {k: [j for j in range(1, n) if page.parent[j] == k and not out[j]] for k in range(n)}

    def inside(k):
        return [k, *[m for j in below[k] for m in inside(j)]]

    def in_link(k):
        return k != 0 and (page.tag[k] == "a" or in_link(page.parent[k]))

    def count(k):
        nodes = inside(k)
        texts = [(m, html.unescape(t).strip()) for m, _, t in page.text if m in nodes and not out[m]]
        return (
            sum(len(t) for _, t in texts),
            len(nodes) - 1,
            sum(len(t) for m, t in texts if in_link(m)),
            sum(page.tag[m] == "a" for m in nodes[1:]),
        )

    body = next((k for k in range(n) if page.tag[k] == "body"), 0)
    body = body if count(body)[0] else 0
    density = {}
    for k in range(n):
        c, t, lc, lt = count(k)
        if out[k] or not c:
            density[k] = 0.0
            continue
        cb, _, lcb, _ = count(body)
        base = math.log(c / (max(1, c - lc)) * lc + lcb / cb * c + math.e)
        ratio = c / max(1, lc) * (max(1, t) / max(1, lt))
        density[k] = c / max(1, t) * math.log(max(1, ratio)) / math.log(base) if base > 1 + 1e-9 else None

    def parts(k):
        return [m for j in below[k] for m in (parts(j) if page.tag[j] in INLINE else [j])]

    total = {k: sum(density[j] or 0.0 for j in parts(k)) for k in range(n)}
    return density, total


def test_densities_equal_the_definition():
    import random

    from continuity.llm.maintext import Measured, Page, _left_out

    rng = random.Random(6)

    def piece(depth):
        tag = rng.choice(["div", "p", "section", "b", "a", "span", "li", "x-box"])
        inner = "".join(
            piece(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["word ", "some more words here ", "&amp; ", ""])
            for _ in range(rng.randint(0, 4))
        )
        return f"<{tag}>{inner}</{tag}>"

    seen = 0
    for _ in range(120):
        # A link in the page keeps the logarithm's base above one everywhere.
        page = Page("<html><body>" + "".join(piece(4) for _ in range(3)) + "text <a href=x>link</a></body></html>")
        out = _left_out(page)
        found = Measured(page, out)
        density, total = literal(page, out)
        for k in range(len(page.tag)):
            if page.tag[k] in INLINE and any(page.tag[j] not in INLINE for j in range(len(page.tag)) if page.parent[j] == k):
                continue
            if density[k] is not None:
                assert abs(found.density[k] - density[k]) < 1e-6 * max(1, density[k])
                seen += 1
            if page.tag[k] not in INLINE and not out[k]:
                assert abs(found.total[k] - total[k]) < 1e-6 * max(1, total[k])
    assert seen > 800
