"""Operator 9: main text of web pages by tag-path ratios.

Text length and punctuation are summed per root-to-leaf tag path of a page,
turned into a ratio per path, smoothed over neighbouring text nodes, fused
with the ratios of the path's containers, and compared with the page's best
path.  The paths that pass say which elements hold the content: an article or
main that any of them is in, or else the deepest container of most of the best
path's text.  In those, blocks are judged by ratios of their own: one whose text is
mostly that of links, without sentences, is a list of links, not text.  All
other text there is the content, however short, and so is a block elsewhere
whose paths pass and which holds a fair part of the text.

Names and tags (nav, footer, class "comments") only say what to doubt: an element
so marked goes unless nearly all of the page's text is in it, as in a form around a whole page.

Scale: one scan, no shuffle; the state is one page at a time.  Paths and elements are
numbers with a parent each and are summed into their parents once, so a page
takes time in proportion to its length, however deep its tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the best path's ratio that a path must reach.
CUT = 0.12
#: Share of the best path's text that its container holds at least.
MOST = 0.5
#: Part of a container's ratio that its paths inherit.
INHERIT = 0.5
#: Factor for paths outside the article, in pages that have one.
OUTSIDE = 0.1
#: Weight of a neighbouring text node when ratios are smoothed.
NEIGHBOUR = 0.25

#: Share of the page's text outside marked elements below which the marks are no reason to drop.
WRAPPED = 0.1
#: Share of the content's text that a block elsewhere must hold to be content too.
BESIDE = 0.15
#: Share of a block's text that stands in links, and their number, from which on it is a list of links.
LINKED, LINKS = 0.6, 3
#: Share of the page's text up to which a block is judged by its links.
LINK_BLOCK = 0.3

# Element kinds of HTML, and names by which pages mark what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("button canvas datalist head iframe input noscript object script select style svg template textarea title".split())
DROPPED = frozenset("aside dialog footer form label menu nav".split())
JUDGED = frozenset("div section ul ol dl table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# The heading of a part of the page that readers wrote.
READERS = re.compile(r"(\d+\s+)?(reader |user |readers' )?(comments?|responses|replies|discussion|kommentare?|commentaires?|comentarios?)(\s*\(?\d+\)?)?:?", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
                   "table tbody td tfoot th thead tr ul".split())
MARKED = frozenset("ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline comment comments "
                   "consent cookie cookies disqus feedback footer gdpr hidden masthead menu modal nav navbar navigation "
                   "newsletter notice notification pager pagination popup privacy promo promoted promotion recommended related "
                   "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
                   "toolbar widget".split())
# What may stand behind such a name in a class, and words that make it say something about another part of the page.
PARTS = frozenset("area bar block body bottom box button buttons column container content form group header heading holder icon icons "
                  "inner item items label left link links list message outer overlay panel post posts right row section slot text "
                  "title toggle top unit wrap wrapper zone".split())
ABOUT = frozenset("with without no not non has have hide hides show shows".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT = frozenset(["article", "main"])
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
             "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
CONTAINERS = frozenset(["div", "section", "td"])
FENCES = frozenset("table ul ol dl article section main div body".split())
SENTENCE = re.compile(r"[.!?…。！？]")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


def _names_other(value: str) -> bool:
    """Whether a class or id says that an element is not article text: one of its names is a marker, or ends in one."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        while len(words) > 1 and (words[-1] in PARTS or words[-1].isdigit()):
            words.pop()
        if words and words[-1] in MARKED and not ABOUT.intersection(words):
            return True
    return False


def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element and all below it is never shown as text."""
    if tag in NO_TEXT:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element calls itself something else than article text. ``inside``: within an article."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if tag in ("html", "body", *CONTENT):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id") and _names_other(value) or name == "role" and value in ROLES:
            return True
    return False


class Page(HTMLParser):
    """Text nodes of a page (element, block number, text) outside elements without text, and its elements.

    Element 0 stands for the page; an element's parent has a smaller number.
    Tag paths are numbers too: that of the parent's path and the tag make one.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.path, self.tag, self.marked = [0], [0], [""], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.path_parent, self.path_tag = [0], [""]
        self.open: list[tuple[str, int, bool]] = []  # tag, element, without text
        self.count: dict[str, int] = {}  # open elements by tag
        self.nodes: list[tuple[int, int, str]] = []
        self.block = 0

    def _pop(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            self.count[tag] -= 1
        if any(tag in BLOCKS for tag, _, _ in self.open[at:]):
            self.block += 1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            self.block += tag == "hr"
            return
        ends = CLOSED_BY.get(tag, frozenset())
        if tag in BLOCKS and self.count.get("p") or any(self.count.get(t) for t in ends):
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name in ends or name == "p" and tag in BLOCKS:
                    self._pop(k)
                    break
                if name in FENCES:
                    break
        if tag in BLOCKS:
            self.block += 1
        above = self.open[-1][1] if self.open else 0
        silent = bool(self.open) and self.open[-1][2] or _hidden(tag, attrs)
        inside = any(self.count.get(t) for t in CONTENT)
        key = self.path[above], tag
        path = self.paths.get(key)
        if path is None:
            path = self.paths[key] = len(self.path_parent)
            self.path_parent.append(key[0])
            self.path_tag.append(tag)
        self.open.append((tag, len(self.parent), silent))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.parent.append(above)
        self.path.append(path)
        self.tag.append(tag)
        self.marked.append(not silent and _marked(tag, attrs, inside))

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCKS and self.open[k][0] in FENCES:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.nodes.append((self.open[-1][1] if self.open else 0, self.block, data))

    def sums(self, values: dict[int, float]) -> list[float]:
        """Of each element the sum of ``values`` over it and all below it."""
        out = [0.0] * len(self.parent)
        for e, v in values.items():
            out[e] += v
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one above it is ``own``."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def _lengths(page: Page, nodes: list[tuple[int, int, str]]) -> dict[int, float]:
    out: dict[int, float] = {}
    for e, _, text in nodes:
        out[e] = out.get(e, 0.0) + len(" ".join(text.split()))
    return out


def shown(page: Page) -> list[tuple[int, int, str]]:
    """Text nodes outside marked elements, and outside parts that readers wrote.

    Where hardly any text is left so, marked elements that hold most of the text
    are taken for wrappers of the page, and only those inside them go.
    """
    lengths = _lengths(page, page.nodes)
    total = sum(lengths.values())
    gone = page.inherited(page.marked)
    if sum(v for e, v in lengths.items() if not gone[e]) < WRAPPED * total:
        below = page.sums(lengths)
        gone = page.inherited([m and below[e] <= MOST * total for e, m in enumerate(page.marked)])
    first: dict[int, tuple[int, str]] = {}  # of each div and section: its first text
    readers = [False] * len(page.parent)
    for e, _, text in page.nodes:
        line = " ".join(text.split())
        if not line or gone[e]:
            continue
        up = e
        while up and up not in first:
            first[up] = e, line
            up = page.parent[up]
    for up, (e, line) in first.items():
        if page.tag[up] in ("div", "section") and page.tag[e] in HEADINGS and READERS.fullmatch(line):
            readers[up] = True
    below = page.sums(lengths)
    readers = page.inherited([r and below[e] <= MOST * total for e, r in enumerate(readers)])
    return [n for n in page.nodes if not gone[n[0]] and not readers[n[0]]]


def path_ratios(page: Page, nodes: list[tuple[int, int, str]]) -> list[float]:
    """Fused ratio of every path: text length per node, raised by punctuation, smoothed, with what containers give."""
    size = len(page.path_parent)
    sums = [[0.0, 0.0, 0.0] for _ in range(size)]
    for e, _, text in nodes:
        s = sums[page.path[e]]
        s[0] += len(" ".join(text.split()))
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    for p in range(size - 1, 0, -1):  # the path's containers
        up = sums[page.path_parent[p]]
        for k in range(3):
            up[k] += sums[p][k]
    ratio = [s[0] / s[2] * (1 + min(1.0, s[1] / s[2])) if s[2] else 0.0 for s in sums]
    # smoothing: a path's ratio leans to those of the nodes next to its own in the page
    near: dict[int, list[float]] = {}
    for (a, _, _), (b, _, _) in zip(nodes, nodes[1:]):
        a, b = page.path[a], page.path[b]
        near.setdefault(a, []).append(ratio[b])
        near.setdefault(b, []).append(ratio[a])
    in_content = [False] * size
    for p in range(1, size):
        in_content[p] = in_content[page.path_parent[p]] or page.path_tag[p] in CONTENT
    has_article = any(c and s[2] for c, s in zip(in_content, sums))
    fused = [0.0] * size
    for p in range(1, size):
        if not sums[p][2] or page.path_tag[p] in ("html", "body"):
            continue
        own = (1 - NEIGHBOUR) * ratio[p] + NEIGHBOUR * (sum(near[p]) / len(near[p]) if p in near else ratio[p])
        fused[p] = max(own * (OUTSIDE if has_article and not in_content[p] else 1.0), INHERIT * fused[page.path_parent[p]])
    return fused


def content_elements(page: Page, nodes: list[tuple[int, int, str]], fused: list[float], best: float) -> tuple[set[int], bool]:
    """Numbers of the elements whose text is the content, and whether that is what stands right in the body.

    Those are the outermost articles and mains with a path that passes.  If the
    best path is in none, the deepest container of most of its text is the
    content; if only the body is one, its text outside div and section is.
    """
    outer = [0] * len(page.parent)  # the outermost article or main
    depth = [0] * len(page.parent)
    for e in range(1, len(page.parent)):
        up = page.parent[e]
        depth[e] = depth[up] + 1
        outer[e] = outer[up] or (e if page.tag[e] in CONTENT else 0)
    chosen: set[int] = set()
    held: dict[int, float] = {}
    for e, _, text in nodes:
        if outer[e]:
            if fused[page.path[e]] >= CUT * best:
                chosen.add(outer[e])
        elif fused[page.path[e]] == best:
            held[e] = held.get(e, 0.0) + len(text.strip())
    total = sum(held.values())
    below = page.sums(held)
    most = [(depth[e], e) for e, length in enumerate(below) if length > MOST * total and page.tag[e] in CONTAINERS
            and not (page.tag[e] == "td" and held.get(e))]
    if total and most:
        chosen.add(max(most)[1])
    return chosen, total > 0 and not most


def link_blocks(page: Page, nodes: list[tuple[int, int, str]]) -> list[bool]:
    """Elements that are, or are in, a block of links: most of its text in links, several of them, no sentence beside them."""
    linked = page.inherited([t == "a" for t in page.tag])
    lengths = _lengths(page, nodes)
    total = sum(lengths.values())
    links, marks, seen = {}, {}, set()
    for e, _, text in nodes:
        if linked[e]:
            if text.strip() and e not in seen:
                seen.add(e)
                links[e] = links.get(e, 0) + 1
        else:
            marks[e] = marks.get(e, 0) + len(SENTENCE.findall(text))
    text, own, many, said = (page.sums(x) for x in (lengths, {e: v for e, v in lengths.items() if linked[e]}, links, marks))
    return page.inherited([page.tag[e] in JUDGED and many[e] >= LINKS and own[e] >= LINKED * text[e] and not said[e] and text[e] <= LINK_BLOCK * total
                           for e in range(len(text))])


def main_text(html: str | None) -> str:
    """The article of a page: content blocks in page order, white space collapsed, joined by one newline."""
    page = Page()
    page.feed(html or "")
    page.close()
    every = shown(page)
    nodes = [n for n in every if n[2].strip()]
    if not nodes:
        return ""
    fused = path_ratios(page, nodes)
    best = max(fused[page.path[e]] for e, _, _ in nodes)
    chosen, in_body = content_elements(page, nodes, fused, best)
    inside = page.inherited([e in chosen for e in range(len(page.parent))])
    links = link_blocks(page, nodes)
    lengths = _lengths(page, nodes)
    below = page.sums(lengths)
    content = sum(v for e, v in lengths.items() if inside[e])
    # a block elsewhere: the outermost div, section or table cell without chosen content in it
    holds = page.sums({e: 1.0 for e in chosen})
    beside = [0] * len(page.parent)
    apart = [False] * len(page.parent)  # in a div or section
    for e in range(1, len(page.parent)):
        up = page.parent[e]
        apart[e] = apart[up] or page.tag[e] in ("div", "section")
        beside[e] = beside[up] or (e if page.tag[e] in CONTAINERS and not holds[e] and not inside[e] else 0)
    blocks: dict[int, list[str]] = {}
    for e, block, text in every:
        if inside[e]:
            keep = not links[e]
        else:
            # text right under html or body, or in a page without tags, has no path to judge by but its own
            fair = not content or not beside[e] or below[beside[e]] >= BESIDE * content
            keep = best == 0.0 or in_body and not apart[e] or fused[page.path[e]] >= CUT * best and fair and not links[e]
        if keep:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; null, empty or textless html gives an empty text.

    Rows are independent: repeats and null ids or addresses give rows of their
    own, broken markup is read as far as it goes, very long pages and unclosed tags take
    time in proportion, an empty table gives an empty one, other columns do not matter.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return (p.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
            .withColumnsRenamed({"id": id_col, "url": url_col}))


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
