"""Page extraction: wrappers, notices, sidebars, readers' comments, unclosed and deep tags; path ratios against a plain version."""

import random
import time

import pytest

from deliverix.llm import html_extract as H

PARAGRAPHS = [f"Paragraph {k} has some words, and then more of them; it is a text that goes on. Another sentence follows here." for k in range(5)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(PARAGRAPHS)
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(6)) + "</ul>"
NOTE = "<p>We use cookies to make this site better. By going on you agree.</p>"
COMMENTS = "<section><h3>{}</h3><div><b>ann</b><p>Nice text, thanks.</p></div><div><b>bob</b><p>I disagree.</p></div></section>"

PAGES = {
    "form around the body": (f"<body><form id='aspnetForm'><div>{ARTICLE}</div></form></body>", TEXT),
    "marked wrapper of the article": (f"<body><div class='social'><article>{ARTICLE}</article></div></body>", TEXT),
    "marked wrapper alone": (f"<body><div class='widget'>{ARTICLE}</div></body>", TEXT),
    "marked parts inside a wrapper": (f"<body><form><div class='menu'>{LINKS}</div><div>{ARTICLE}</div><div class='sidebar'>x</div></form></body>", TEXT),
    "notice beside the article": (f"<body><div>{ARTICLE}</div><div>{NOTE}</div></body>", TEXT),
    "sidebar in main": (f"<body><main><div class='col-8'>{ARTICLE}</div><div class='col-4'>{LINKS}</div></main></body>", TEXT),
    "comments in an unmarked section": (f"<body><article>{ARTICLE}{COMMENTS.format('Comments')}</article></body>", TEXT),
    "counted comments": (f"<body><article>{ARTICLE}{COMMENTS.format('12 Comments')}</article></body>", TEXT),
    "a section about comments stays": (f"<body><article>{ARTICLE}<section><h3>How comments work</h3><p>Like this.</p></section></article></body>", f"{TEXT}\nHow comments work\nLike this."),
    "long comments, short article": (f"<body><article><p>{PARAGRAPHS[0]}</p></article><div class='comments'>{ARTICLE}</div></body>", PARAGRAPHS[0]),
    "links with sentences stay": (f"<body><article>{ARTICLE}<ul>" + "".join(f"<li><a>Source {k}</a>, read in {k}.</li>" for k in range(4)) + "</ul></article></body>",
                                  TEXT + "".join(f"\nSource {k}, read in {k}." for k in range(4))),
    "article in two blocks": (f"<body><div>{ARTICLE}</div><div>{ARTICLE}</div></body>", f"{TEXT}\n{TEXT}"),
    "list and table in the article": (f"<body><article>{ARTICLE}<ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article></body>", f"{TEXT}\none\ntwo\na\nb"),
    "no tags": ("just  text &amp; more", "just text & more"), "empty": ("", ""), "null": (None, ""), "only markup": ("<body><nav>x</nav><script>y</script></body>", "x"),
    "broken": ("<article><p>a<b>b</i></p></article></div></p>", "ab"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages(name):
    html, want = PAGES[name]
    assert H.main_text(html) == want


@pytest.mark.parametrize("html", ["<body><div>" + "<b>word " * 10_000, "<body>" + "<div>word " * 10_000, "<body><div>" + "<b>w " * 5000 + "<p>text here.</p>" * 5000,
                                  "<p>" + "a</i>" * 20_000, "<table>" + "<tr><td>x" * 10_000, "<ul>" + "<li>x" * 10_000, "</p>" * 20_000, "<div>" * 20_000 + "</div>" * 20_000])
def test_time_grows_with_the_page(html):
    start = time.process_time()
    H.main_text(html)
    assert time.process_time() - start < 1.5


def plain_ratios(page, nodes):
    """Ratios by path tuples, every prefix of every node's path summed for itself."""
    def path(e):
        out = ()
        while e:
            out = (page.tag[e], *out)
            e = page.parent[e]
        return out

    at = [(path(e), " ".join(text.split())) for e, _, text in nodes]
    prefixes = {p[:k] for p, _ in at for k in range(1, len(p) + 1)}
    ratio = {}
    for p in prefixes:
        texts = [t for q, t in at if q[:len(p)] == p]
        ratio[p] = sum(map(len, texts)) / len(texts) * (1 + min(1.0, sum(len(H.PUNCTUATION.findall(t)) for t in texts) / len(texts)))
    ratio[()] = 0.0
    near = {p: [ratio[b] if a == p else ratio[a] for (a, _), (b, _) in zip(at, at[1:]) if p in (a, b) for _ in range(1 + (a == b))] for p in prefixes}
    article = any(t in H.CONTENT for p in prefixes for t in p)
    fused = {(): 0.0}
    for p in sorted(prefixes, key=len):
        own = (1 - H.NEIGHBOUR) * ratio[p] + H.NEIGHBOUR * (sum(near[p]) / len(near[p]) if near[p] else ratio[p])
        own *= H.OUTSIDE if article and not H.CONTENT.intersection(p) else 1.0
        fused[p] = 0.0 if p[-1] in ("html", "body") else max(own, H.INHERIT * fused[p[:-1]])
    return [(fused[p], p) for p, _ in at]


def test_path_ratios_against_plain_version():
    rng = random.Random(6)
    for _ in range(60):
        tags = ["div", "p", "section", "ul", "li", "b", "article", "td", "span"]
        html = "<body>" + "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some text. ", "more, text; here! ", "x"]) for _ in range(rng.randint(2, 60)))
        page = H.Page()
        page.feed(html)
        page.close()
        nodes = [n for n in page.nodes if n[2].strip()]
        fused = H.path_ratios(page, nodes)
        for (e, _, _), (want, path) in zip(nodes, plain_ratios(page, nodes)):
            assert not path or fused[page.path[e]] == pytest.approx(want), (html, path)


def test_rows(spark, odd_rows):
    rows = [(1, "u", PAGES["sidebar in main"][0]), (1, "u", PAGES["sidebar in main"][0]), (None, None, None), (2, None, "<p>" + odd_rows[9 + 2][1] if odd_rows[11][1] else "")]
    rows += [(3, "v", "<article><p>" + " ".join(w for _, t, _ in odd_rows if t for w in t.split()) + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS id")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract(df).collect()))
    assert got == sorted((i or 0, u or "", H.main_text(h), len(H.main_text(h))) for i, u, h in rows)
    assert H.extract(df.limit(0)).collect() == []
