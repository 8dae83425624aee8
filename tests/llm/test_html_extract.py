import html
import math
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import html_extract as x
from tests.llm.data import pages, rows_of

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use</div>
<main><article><header><h1>Title &amp;\n more</h1><span>share</span></header><p>One <b>two</b>&nbsp;three.<br>Four<p>s</p><form>f <input></form><div id="adBanner">ad</div><script>"<p>no</p>"</script>
<ul><li>a<li>b</ul><section class="reader-comments"><p>hi</p></section></article><aside>x</aside></main><footer>f</footer>"""


def test_main_text():
    assert x.main_text(PAGE) == "Title & more\nOne two three. Four\ns\na\nb"
    assert [x.main_text(t) for t in ("", "plain", "<p>a<p>b", "&lt;p&gt;", "<nav>m</nav>", "<!-- c -->y<script>z", "<b>" * 3000 + "q" + "</i>" * 3000)] == ["", "plain", "a\nb", "<p>", "", "y", "q"]
    body = "<div class='sidebar'>x</div><div><h1>T</h1><p>A long paragraph of content.</p><p>s</p></div><div id='comments'><p>long long long long comment</p></div>"
    assert x.main_text(body) == "T\nA long paragraph of content.\ns"


def test_pages_without_one_plain_article():
    long, short = "A long paragraph of content that goes on. " * 20, "Another paragraph of the same content, which is shorter. " * 3
    long, short = long.strip(), short.strip()
    assert x.main_text(f"<body><h1>T</h1><div>{long}</div></body>") == f"T\n{long}"
    assert x.main_text(f"<body><nav>m</nav><div><div><p>{long}</p></div><div><p>{short}</p></div></div></body>") == f"{long}\n{short}"
    assert x.main_text(f"<body><article><p>{long}</p></article><article><p>{short}</p></article></body>") == f"{long}\n{short}"
    assert x.main_text(f"<body><article class='post has-sidebar'><p>{long}</p></article><p class='ad'>{short}</p></body>") == long
    assert x.main_text(f"<body><div id='content' class='no-comments'><p>{long}</p></div><div class='comments'>{short}</div></body>") == long
    assert x.main_text(f"<body><div class='social-post'><p>{long}</p></div><div class='comments'>{short}</div></body>") == long
    assert x.main_text(f"<body><article><p>{short}</p></article><div class='comments'>{long}</div></body>") == short


LONG = " ".join(f"Sentence {i} of the article goes on for a while." for i in range(12))
BODY = "".join(f"<p>{LONG} {k}</p>" for k in range(3))
TEXT = "\n".join(f"{LONG} {k}" for k in range(3))


@pytest.mark.parametrize(
    "page",
    [
        "<article class='has-sidebar'>{}</article>", "<div id='page' class='no-sidebar'>{}</div>", "<div class='content with-ads'>{}</div>", "<div class='post form-article'>{}</div>",
        "<form id='aspnetForm'><input>{}</form>", "<div>{}</div><div class='bottom'>Copyright of us</div>", "<div><a>Home</a> | <a>News</a> | <a>More</a></div><div>{}</div>",
        "<div><ul><li><a>Home</a><li><a>News</a><li><a>More</a></ul>{}</div>", "<article>{}</article><div class='comment-list'><p>" + LONG + "</p></div>",
        "<article>{}<ol class='commentlist'><li>" + LONG + "</ol></article>", "<article>{}</article><div id='cookiebar'>" + LONG + "</div>", "<div class='newsletter-story'>{}</div>",
        "<main>{}<div id='comments'>" + LONG + "</div></main>", "<div class='left-sidebar'>" + LONG + "</div><div>{}</div>", "<!-- <p>x</p> --><![CDATA[ y ]]><![if x]><?z?><div>{}</div><!-- never ends",
    ],
)
def test_wrappers_and_neighbours_of_an_article(page):
    assert x.main_text(f"<html><body>{page.format(BODY)}</body></html>") == TEXT


def test_a_name_that_says_more_than_advert_does_not_set_a_block_apart():
    assert x.main_text(f"<article>{BODY}<p class='share-price'>{LONG}</p><p class='share-buttons'>{LONG}</p></article>") == f"{TEXT}\n{LONG}"


def test_ratios_and_smoothing_by_hand():
    ratios = [30.0, 0.5, 12.0, 7.0, 0.0]
    weight = lambda d: math.exp(-0.5 * (d / x.SIGMA) ** 2) if abs(d) <= int(3 * x.SIGMA) else 0.0
    want = [sum(weight(i - j) * r for j, r in enumerate(ratios)) / sum(weight(i - j) for j in range(len(ratios))) for i in range(len(ratios))]
    assert x.smoothed(__import__("numpy").array(ratios)).tolist() == pytest.approx(want)
    page = x.Lines()
    page.feed("<p>one <b>two</b></p><p>three</p><ul><li>four")
    page.close()
    # tags from the end of the line before: <p> <b> </b>; </p> <p>; </p> <ul> <li>
    assert [(text, tags) for _, text, tags, *_ in page.lines] == [("one two", 3), ("three", 2), ("four", 3)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<p>", "</p>", "<![", "<!", "<!--", "-->", "]]>", "<?", "</", "<a href=", "<li>", "<form>", "<article>", "</div>", "<div class='ad'>", "<h1>", "&#x0;", "&amp", "<script>", "'", '"', ">", "text "]), st.text(max_size=8)), max_size=30))
def test_no_bytes_stop_a_page(parts):
    got = x.main_text("".join(parts))
    assert got == "\n".join(" ".join(line.split()) for line in got.split("\n"))


@pytest.mark.parametrize("flood", ["<a ", "<!--", "<div>", "<table><tr><td>", "<ul><li>", "<span>x<div></div>", "</p", "<?", "<h1>x", "<p><b>"])
def test_time_grows_with_the_page(flood):
    def took(size):
        began = time.process_time()
        x.main_text(flood * (size // len(flood)))
        return time.process_time() - began

    took(10_000)
    assert took(1_000_000) < 12 * took(125_000) + 1


def test_smoothing_keeps_a_constant():
    import numpy as np

    assert np.allclose(x.smoothed(np.full(7, 3.0)), 3.0) and np.allclose(x.smoothed(np.array([5.0])), 5.0)


def test_pages_against_the_marked_article(spark):
    for url, page, got in rows_of(spark, x.extract(pages(spark), out="found").drop("page_id"), pages(spark)):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got == "\n".join(p for p in parts if p), url


def test_edges(spark):
    df = spark.createDataFrame([(None, None, "old"), (1, "", "old"), (1, "<p>é🎈 x</p>", "old"), (1, "<p>é🎈 x</p>", "old"), (2, "<p>" + "word " * 200_000, "old")], "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in x.extract(df).collect()]
    assert got[:4] == [(None, ""), (1, ""), (1, "é🎈 x"), (1, "é🎈 x")] and len(got[4][1]) == 999_999
    assert x.extract(df.limit(0)).collect() == []


PARAGRAPH = "Ein langer Absatz mit genug Text, der zum Inhalt gehört und mehr als eine Zeile füllt, damit sein Verhältnis hoch ist."


def bare(*more):
    """A page without article or main: paragraphs right in the body, and what stands around them."""
    before, after = more
    return f"<html><body>{before}<p>{PARAGRAPH} Eins.</p><p>Kurz</p><p>{PARAGRAPH} Zwei.</p><p>Ein kurzer Schluss.</p>{after}</body></html>"


def test_lines_at_the_rims_of_a_bare_body_leave_by_their_ratio(monkeypatch):
    want = f"{PARAGRAPH} Eins.\nKurz\n{PARAGRAPH} Zwei.\nEin kurzer Schluss."
    given = bare("<div>Home | About | Contact</div><div>Example</div>", "<div>© 2020 Company</div><div class='discussion'><p>" + PARAGRAPH + "</p></div><div class=werbung><p>" + PARAGRAPH + "</p></div>")
    assert x.main_text(given) == want
    # the same, if the threshold did nothing, would keep what stands at the rims
    monkeypatch.setattr(x, "RIM", 0)
    assert x.main_text(given) == f"Home | About | Contact\nExample\n{want}\n© 2020 Company"


def test_ratio_smoothing_threshold_and_rims_by_brute_force():
    import math
    import random

    rng = random.Random(2)
    for _ in range(60):
        lines = [rng.choice(["Menu", "Home | Kontakt", PARAGRAPH, PARAGRAPH + " " + PARAGRAPH, "Ein Satz.", "© 2020", PARAGRAPH[:59]]) for _ in range(rng.randint(1, 9))]
        tags = [rng.choice(("p", "pre")) for _ in lines]
        page = "<html><body>" + "".join(f"<{e}>{t}</{e}>" for e, t in zip(tags, lines, strict=True)) + "</body></html>"
        # the first line has the start tags of page, body and paragraph before it, the others an end tag and a start tag
        own = [len(t) / (3 if i == 0 else 2) for i, t in enumerate(lines)]
        ratios = []
        for i in range(len(own)):
            near = [(math.exp(-0.5 * ((i - j) / x.SIGMA) ** 2), own[j]) for j in range(len(own)) if abs(i - j) <= int(3 * x.SIGMA)]
            ratios.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        least = x.RIM * sum(ratios) / len(ratios)
        clear = [min(a, b) >= least for a, b in zip(ratios, own, strict=True)]
        sure = [i for i, ok in enumerate(clear) if ok]
        stays = lambda i, end: clear[i] or lines[i].endswith(".") or tags[i] == tags[end]
        want = [t for i, t in enumerate(lines) if not sure or sure[0] <= i <= sure[-1] or stays(i, sure[0] if i < sure[0] else sure[-1])]
        assert x.main_text(page).split("\n") == want, lines


def test_comments_end_as_in_a_browser():
    for comment in ("<!-- a --!>", "<!-->", "<!--->", "<!-- a -- b -->", "<!-- <p>no</p> --!>"):
        assert x.main_text(f"<article><p>Eins</p>{comment}<p>Zwei</p></article>") == "Eins\nZwei", comment
    assert x.main_text("<article><p>Eins</p><!-- never ends <p>Zwei</p></article>") == "Eins"
