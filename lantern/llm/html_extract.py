"""HTML extraction by text-to-tag ratios.

The standard library's parser streams a page as events. Block elements end a line; each line has its text,
its tags and the element it stands in. The text-to-tag ratios of the lines are smoothed by a Gaussian and
split by a threshold into content and other lines. The content region is the smallest container that
has all content lines of a ratio of their own above the threshold, the headings right before them and the page's
``h1``; an ``article`` or ``main`` element is not divided further. The region's lines are the main text, short ones
between content lines included. Outside of ``article`` and ``main``, lines before the first line of clear text and after the last leave if their smoothed
ratio is below half of the page's, they are no sentences and stand apart from that line: menus without links, copyright lines. Lines in elements that are something else leave anywhere:

- by tag (``nav``, ``footer``, ``script``...), role, or being hidden;
- by a name among class and id that says nothing else than that (``sidebar``, ``cookie-notice``, ``comment-list``; not
  ``has-sidebar``, ``share-price`` or ``form-article``), and forms. Neither counts on an ``article``, nor on an element with most of
  the page's text, if no article or main has text beside it: such an element is a wrapper;
- by three links or more in a row and nothing else, outside of an article.

A heading in the header of an article stays. Each page is parsed by itself in the task that reads it, so there is
no shuffle, and memory is that of one page and its lines beside the batch. Time is in proportion to the page,
whatever it holds: what is open is looked up by tag, and a comment or tag that never ends ends the page.

Defined results: a null or empty page, or one without text outside such elements, has the empty text;
broken markup is read as a browser would, declarations and marked sections up to the next ``>``; a very long page is
read whole; of regions that tie the inner one is taken; repeated rows give repeated results; an empty table gives
an empty result; columns of the input with the names of the outputs are replaced.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.common import table

#: Share of the page's text with which an element's words do not count; deviation of the Gaussian in lines;
#: part of the smoothed ratios' standard deviation that is the threshold, and of their mean that clear text has.
MOST, SIGMA, LEVEL, RIM = 0.5, 1.0, 0.5, 0.5
#: Pages that go through Python at once.
SLICE_ROWS = 256

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("html body div section center table tbody tr td article main".split())
WHOLE = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are never main text.
APART_TAGS = set("head script style noscript template nav footer aside button select textarea input iframe object svg canvas audio video map datalist dialog menu".split())
APART_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that mark an element as something else, if its class or id has no other words than these and plain ones.
APART_WORDS = set(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dropdown "
    "footer form gdpr login masthead menu modal nav navbar navigation navi newsletter notice notification notifications overlay pager pagination popup privacy promo promoted "
    "promotion recommended recommendations related replies reply respond search share sharing sidebar signup sitemap social sponsor sponsored subscribe subscription toolbar topbar widget widgets "
    "discussion discussions anzeige anzeigen werbung kommentar kommentare seitenleiste publicite commentaire commentaires publicidad anuncio anuncios comentario comentarios".split()
)
PLAIN_WORDS = set(
    "accept area articles bar block body bottom box btn button buttons center col column container content desktop fixed global group header heading icons inline inner "
    "item items layout left link links list main media message mobile module news outer page panel policy post posts primary prompt reading right row secondary section settings site slot small sticky stories text "
    "all latest more popular reader readers recent the thread title top topics unit user users visitor website wp wrap wrapper".split()
)
HEADER_WORDS = {"header"}
#: Names that tell what an element has, not what it is.
STATES = re.compile(r"(?:has|have|no|not|with|without|hide)[-_]")
#: What ends a comment, and what ends a sentence, quotes and brackets after it included.
COMMENT_END, SENTENCE = re.compile("--!?>"), re.compile("[.!?…:;。！？][\"'”’»«)\\]]*$")
#: Links in a row that are a menu.
MENU = 3
#: A start tag of the first closes an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK - CLOSES.keys() - {"html", "body", "option", "optgroup", "caption", "tbody", "thead", "tfoot"}}

#: What a start tag does not look behind for one that it closes.
LIMITS = CONTAINER | {"ul", "ol", "dl", "select", "blockquote"}

MAIN, HEADER, APART = 0, 1, 2


@functools.lru_cache(4096)
def parts(word: str) -> frozenset[str]:
    """The word, or the two known words that it is made of (``commentlist``)."""
    known = APART_WORDS | PLAIN_WORDS
    cuts = [] if word in known else [i for i in range(2, len(word) - 1) if word[:i] in known and word[i:] in known]
    return frozenset((word[: cuts[0]], word[cuts[0] :]) if cuts else (word,))


def names_apart(attrs: dict[str, str | None]) -> tuple[bool, bool]:
    """Whether a name of the class or id says that the element is something else, or a header."""
    apart = header = False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        if not STATES.match(name.lower()):
            words = set().union(*map(parts, re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())))
            apart |= bool(words & APART_WORDS) and words <= APART_WORDS | PLAIN_WORDS
            header |= bool(words & HEADER_WORDS) and words <= HEADER_WORDS | PLAIN_WORDS
    return apart, header


class Lines(HTMLParser):
    """Elements by number (0 is the page) and the lines of text in them."""

    def __init__(self, trusted: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.trusted = trusted
        #: By element: apart without regard to names, and characters before and in those that names set apart.
        self.plain, self.since, self.named = [MAIN], {}, {}
        self.chars, self.whole = 0, 0
        self.parent, self.tag, self.zone = [0], ["html"], [MAIN]
        #: Numbers of the open elements; their depths by tag; the depths of those that limit, and numbers of blocks.
        self.stack, self.open, self.limits, self.blocks = [0], {}, [0], [0]
        #: Element, text, tags, kept, and whether it is links and nothing else (how many) of each line.
        self.lines: list[tuple[int, str, int, bool, int]] = []
        #: Text of the line so far, and text inside it that stands in elements apart.
        self.text: list[str] = []
        self.aside: list[str] = []
        self.tags, self.heading, self.links, self.unlinked = 0, 0, 0, False

    # the whole page is fed at once, so what does not end here never does

    def parse_html_declaration(self, i: int) -> int:
        if not self.rawdata.startswith("<!--", i):
            return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)
        # the dashes that begin a comment may be those that end it
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self.parse_html_declaration(i)

    def parse_pi(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def end_line(self) -> None:
        for pieces, kept in ((self.text, self.zone[self.stack[-1]] != HEADER or self.heading > 0), (self.aside, False)):
            if pieces and (text := " ".join("".join(pieces).split())):
                self.lines.append((self.blocks[-1], text, self.tags, kept, 0 if self.unlinked else self.links))
                self.tags = 0
            pieces.clear()
        self.links, self.unlinked = 0, False

    def inside(self, tags: set[str]) -> bool:
        return any(self.open.get(t) for t in tags)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if closed := CLOSES.get(tag):
            depth, name = max(((self.open[t][-1], t) for t in closed if self.open.get(t)), default=(0, ""))
            if depth and depth >= self.limits[-1]:
                self.pop(name)
        self.links += tag == "a"
        above, number = self.stack[-1], len(self.tag)
        own = self.own_zone(tag, dict(attrs), number)
        self.parent.append(above)
        self.tag.append(tag)
        self.zone.append(max(self.zone[above], own))
        self.plain.append(max(self.plain[above], MAIN if number in self.since else own))
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in LIMITS:
            self.limits.append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(number)
        self.stack.append(number)
        self.heading += tag in HEADING

    def own_zone(self, tag: str, attrs: dict[str, str | None], number: int) -> int:
        if tag in APART_TAGS:
            return APART
        in_article = self.inside(WHOLE)
        if tag == "header":
            return HEADER if in_article else APART
        if not attrs and tag != "form" or tag in ("html", "body", "main"):
            return MAIN
        style = re.sub(r"\s", "", attrs.get("style") or "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or (attrs.get("role") or "").lower() in APART_ROLES:
            return APART
        if tag in WHOLE or number in self.trusted:
            return MAIN
        apart, header = names_apart(attrs)
        if apart or tag == "form":
            self.since[number] = self.chars
            return APART
        if header:
            return HEADER if in_article or tag in HEADING else APART
        return MAIN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # as in a browser, the slash closes nothing but void elements and what has no other end
        if tag not in VOID and tag not in BLOCK:
            self.pop(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        self.pop(tag)

    def pop(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        if tag in BLOCK:
            self.end_line()
        while True:
            number = self.stack.pop()
            if number in self.since:
                self.named[number] = self.chars - self.since[number]
            top = self.tag[number]
            self.open[top].pop()
            if top in LIMITS:
                self.limits.pop()
            if top in BLOCK:
                self.blocks.pop()
            self.heading -= top in HEADING
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        zone = self.zone[self.stack[-1]]
        if self.plain[self.stack[-1]] != APART:
            size = len(data.strip())
            self.chars += size
            if zone == MAIN and self.inside(WHOLE):
                self.whole += size
        if zone != APART and not self.open.get("a") and any(c.isalnum() for c in data):
            self.unlinked = True
        (self.aside if zone == APART else self.text).append(data)

    def close(self) -> None:
        super().close()
        self.end_line()
        for i in self.since.keys() - self.named.keys():
            self.named[i] = self.chars - self.since[i]

    def without_menus(self) -> list[tuple[int, str, int, bool]]:
        """The lines; those of a row of links outside of an article are not kept."""
        whole = np.zeros(len(self.tag), bool)
        for i in range(1, len(self.tag)):
            whole[i] = self.tag[i] in WHOLE or whole[self.parent[i]]
        out = []
        for linked, run in itertools.groupby(self.lines, lambda x: x[4] > 0 and not whole[x[0]]):
            run = list(run)
            menu = linked and sum(x[4] for x in run) >= MENU
            out += [(i, text, tags, kept and not menu) for i, text, tags, kept, _ in run]
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over the lines; at the ends the kernel is that part of it that lies inside."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def without_rims(page: Lines, lines: list[int], at: tuple[int, ...], text: tuple[str, ...], ratios: np.ndarray, own: np.ndarray) -> set[int]:
    """Of the ``lines`` of a region those at its rims that are none of it.

    These are lines before the first one that is clearly text, and after the last, of a low ratio, which are no sentence and stand in an
    element of another kind or place than that one does.
    """
    least = RIM * ratios.mean()
    clear = np.minimum(ratios, own) >= least
    sure = [k for k in lines if clear[k]]
    if not sure:
        return set()
    place = lambda k: (page.parent[at[k]], page.tag[at[k]])
    gone = set()
    for end, rim in ((sure[0], [k for k in lines if k < sure[0]]), (sure[-1], [k for k in lines if k > sure[-1]])):
        gone |= {k for k in rim if not clear[k] and page.tag[at[k]] not in HEADING and not SENTENCE.search(text[k]) and place(k) != place(end)}
    return gone


def main_text(html: str) -> str:
    page = Lines()
    page.feed(html)
    page.close()
    if not page.whole and (most := frozenset(i for i, n in page.named.items() if n > MOST * page.chars)):
        page = Lines(most)
        page.feed(html)
        page.close()
    if not page.lines:
        return ""
    at, text, tags, kept = zip(*page.without_menus(), strict=True)
    own = np.array([len(x) for x in text], float) / np.maximum(1, np.array(tags))
    ratios = smoothed(own)
    threshold = LEVEL * ratios.std()
    content = (ratios >= threshold) & np.array(kept)
    # a short line beside a long one is smoothed above the threshold, but does not widen the region
    if not (content := content & (own >= threshold)).any():
        content = np.array(kept)
    first = int(content.argmax())
    headings = {k for k in range(first) if kept[k] and page.tag[at[k]] in HEADING}
    held = set(np.flatnonzero(content).tolist()) | {k for k in headings if page.tag[at[k]] == "h1"}
    for k in range(first - 1, -1, -1):
        if kept[k] and k not in headings:
            break
        held |= {k} & headings
    weight = np.zeros(len(page.tag), int)
    np.add.at(weight, np.array(at)[sorted(held)], 1)
    for i in range(len(page.tag) - 1, 0, -1):
        weight[page.parent[i]] += weight[i]
    region = 0
    for i in range(1, len(page.tag)):
        # containers that hold all of these lines stand in each other, the outer ones first
        if page.tag[i] in CONTAINER and weight[i] == weight[0] > 0:
            region = i
            if page.tag[i] in WHOLE:
                break
    inside = np.zeros(len(page.tag), bool)
    inside[region] = True
    for i in range(region + 1, len(page.tag)):
        inside[i] = inside[page.parent[i]]
    lines = [k for k in range(len(text)) if kept[k] and inside[at[k]]]
    gone = set() if page.tag[region] in WHOLE else without_rims(page, lines, at, text, ratios, own)
    return "\n".join(text[k] for k in lines if k not in gone)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each page in place of the page."""
    keep = [c for c in df.columns if c not in (html, out)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])
    where = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [main_text(x.as_py() or "") for x in part.column(where)]
                yield pa.RecordBatch.from_arrays([*part.columns[:where], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, html).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    found = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
