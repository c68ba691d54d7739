"""Operators against brute force on small tables with nulls, empties, ties, repeats and clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from deliverix.llm import classifier, decontamination, html_extract, jaccard_join, line_dedup, lm_scoring, mixing, quality_rules, substring_dedup, token_output
from deliverix.llm.shared import scratch_path
from spelling_tree import SuffixTree

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def rows_of(df, *cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def id_key(i):
    return (i is not None, i or 0)


def test_line_dedup(make_docs):
    rows = [(i, f"menu\nbody {i}\n\n menu ", "a") for i in range(6)] + [(6, "menu", "b"), (7, None, "a"), (None, "", None), (7, "menu\nx", "a")]
    out = rows_of(line_dedup.dedup_lines(make_docs(rows), max_ratio=0.5), "doc_id", "n_dropped", "text")
    want = [(i, 2, f"body {i}\n") for i in range(6)] + [(6, 0, "menu"), (7, 0, ""), (None, 0, ""), (7, 1, "x")]
    assert out == ordered(want)


def test_token_round_trip(spark, make_docs, odd_rows):
    encoder = token_output.Encoder(token_output.tokenizer_path())
    path = scratch_path(spark, "test")
    token_output.write_tokens(make_docs(odd_rows), path)
    got = rows_of(token_output.read_records(spark, path), "id", "n_tokens", "ids_crc32")
    plain = encoder._t
    want = []
    for i, text, _ in odd_rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids)))
    assert got == ordered(want)
    index = spark.read.parquet(f"{path}/index").collect()
    shard = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/records").collect()}
    for r in index:
        i, ids = token_output.read_tokens(shard[r.shard], r.offset, r.length)
        assert (i, len(ids)) == (r.id, r.n_tokens)
    q = token_output.query(make_docs(odd_rows)).collect()
    total = 0
    for r in sorted(q, key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens
    assert [id_key(r.doc_id) for r in sorted(q, key=lambda r: r.start)] == sorted(id_key(r[0]) for r in odd_rows)


def test_damaged_record_is_found():
    data = bytearray(token_output.frame(b"12345678\x02abcd") + b"\n")
    assert [bytes(p) for _, p in token_output.frames(bytes(data))] == [b"12345678\x02abcd"]
    data[14] ^= 1
    with pytest.raises(ValueError):
        list(token_output.frames(bytes(data)))


def test_added_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(token_output.tokenizer_path())
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    texts = [f(x) for x in added for f in (str, "a b {} c d".format, "one{}two three".format, "{} x".format, "x {}".format)] + ["a b c", "", "x < |end"]
    encoder = token_output.Encoder(token_output.tokenizer_path())
    got = [np.frombuffer(b, encoder.type).tolist() for b in encoder.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_in_order_of_their_numbers(spark):
    names = [f"part-{p:05d}-0f1e-4c5d-c{c:03d}.txt" for p, c in ((0, 0), (0, 101), (0, 999), (0, 1000), (0, 1001), (7, 0), (99999, 2), (100000, 1))]
    df = spark.createDataFrame([(x,) for x in reversed(names)], "shard string")
    assert [r.shard for r in df.orderBy(token_output.shard_place(df["shard"])).collect()] == names


def brute_repeats(rows, window=20):
    first = {}
    for i, text, _ in sorted(rows, key=lambda r: id_key(r[0])):
        w = words(text)
        for k in range(len(w) - window + 1):
            at = (id_key(i), k)
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, at), at)
    out = []
    for i, text, _ in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] != (id_key(i), k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return ordered(out)


def test_substring_dedup(make_docs, odd_rows):
    assert rows_of(substring_dedup.query(make_docs(odd_rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(odd_rows)


def brute_jaccard(rows, t=0.8):
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], r[0]), r[0], key=id_key)
    return ordered([(r[0], least[label[i]], len(near[i])) for i, r in enumerate(rows)])


def test_jaccard_join(make_docs, odd_rows, monkeypatch):
    group = [(100 + k, " ".join(["w%d" % j if j != 10 + 6 * k else "v%d" % k for j in range(140)]), "d") for k in range(18)]
    rows = odd_rows + group
    assert rows_of(jaccard_join.query(make_docs(rows)), "doc_id", "class_id", "n_links") == brute_jaccard(rows)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # the group in several blocks
    assert rows_of(jaccard_join.query(make_docs(rows)), "doc_id", "class_id", "n_links") == brute_jaccard(rows)


def kept_by_class(rows):
    """Brute force: of each class of near duplicates the row of the smallest id; of texts without words all rows."""
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if j == i or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
                 for i in range(len(rows))]
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k), key=id_key) for k in set(label)}
    return least, label, sets


def test_keep_representatives(make_docs, odd_rows):
    near = lambda n, k: " ".join(f"z{n}" if j == k else f"w{n}x{j}" for j in range(140))
    rows = odd_rows + [(None, near(1, 5), "a"), (None, near(2, 5), "a"), (None, near(3, 5), "a"), (70, near(1, 60), "a"), (None, near(2, 5), "a"),
                       (71, near(4, 5), "a"), (71, near(5, 5), "a"), (72, near(5, 90), "a")]
    least, label, sets = kept_by_class(rows)
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_representatives(make_docs(rows)).collect()]
    assert sorted(id_key(i) for i, t in got if words(t)) == sorted(id_key(least[k]) for k in {x for x, s in zip(label, sets) if s})
    at = {(i, t): k for (i, t, _), k in zip(rows, label)}
    assert len({at[r] for r in got if words(r[1])}) == sum(bool(words(t)) for _, t in got)  # one row of each class
    assert ordered([r for r in got if not words(r[1])]) == ordered([(i, t) for i, t, _ in rows if not words(t)])


def test_pruning_bound():
    least = jaccard_join.least_matches(0.8, 1e-9)
    assert len(least) == 4 and all(a < b for a, b in zip(least, least[1:])) and least[0] < 0.5 * 32


def test_common_by_matrix_equals_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, 400).astype(np.uint64)) for _ in range(90)]
    i, j = np.triu_indices(90, 1)
    assert (jaccard_join.common(sets, i, j) == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]).all()


def test_mixing(make_docs):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", "c", None][i % 4]) for i in range(400)] + [(999, None, "e"), (998, "w " * 50, "a"), (998, "w " * 50, "a")]
    docs = make_docs(rows)
    out = mixing.query(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r["size"] for r in out)
    again = mixing.query(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    total = sum(r["size"] for r in out)
    by = {}
    for r, (i, _, s) in zip(sorted(out, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0])):
        t = by.setdefault(s, [r.target, 0, r.source_size])
        t[1] += r.taken
    assert abs(sum(t[0] for t in by.values()) - 1.5 * total) < 1e-6
    assert all(abs(t[0] - t[1]) <= 50 and t[0] <= 2 * t[2] for t in by.values())
    copies = Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect())
    size = {i: len(words(t)) for i, t, _ in rows}
    assert sum(size[i] * n for i, n in copies.items()) == sum(r.taken for r in out)


def test_quality_rules(make_docs, odd_rows):
    out = rows_of(quality_rules.query(make_docs(odd_rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, text, _ in odd_rows:
        w = words(text)
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        want.append((i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
                     len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert out == ordered(want)


@pytest.mark.parametrize("parts", [1_000_000, 7])
def test_decontamination(spark, make_docs, odd_rows, parts):
    bench = spark.createDataFrame([(1, odd_rows[0][1]), (1, odd_rows[0][1]), (2, "Short ONE"), (3, None), (4, ""), (5, "no such words in any text here at all, really none")],
                                  "item_id long, text string")
    norm = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = rows_of(decontamination.scan(make_docs(odd_rows), bench, max_broadcast=parts), "doc_id", "n_words", "hit", "items")
    want = []
    for i, text, _ in odd_rows:
        w, hit, items = norm(text), set(), set()
        for r in bench.collect():
            b = norm(r.text)
            n = min(10, len(b))
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    items.add(str(r.item_id))
        want.append((i, len(w), sorted(hit), sorted(items)))
    assert out == ordered(want)


@pytest.mark.parametrize("parts", [1_000_000, 7])
def test_clean_documents(spark, make_docs, odd_rows, parts):
    rows = odd_rows + [(None, "it was short one of these", "a"), (13, "short one", "a"), (13, "clean text", None), (13, None, "b")]
    bench = spark.createDataFrame([(1, odd_rows[0][1]), (2, "Short ONE"), (3, None)], "item_id long, text string")
    gone = lambda t: t == odd_rows[0][1] or t == odd_rows[3][1] or "short one" in (t or "")
    docs = make_docs(rows)
    out = decontamination.clean_documents(docs, bench, max_broadcast=parts)
    assert out.schema == docs.schema
    assert rows_of(out, "doc_id", "text", "source") == ordered([r for r in rows if not gone(r[1])])


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in classifier.query(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(out[r.doc_id].predicted, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_classifier_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (77, 1), (9, None)], "doc_id long, quality int")
    model = classifier.fit(make_docs(odd_rows), labels)
    assert classifier.score(make_docs(odd_rows), model).count() == len(odd_rows)
    assert classifier.fit(make_docs([]), labels).bias == 0.0
    assert classifier.keep_good(make_docs(odd_rows), model, cut=0.0).count() == len(odd_rows)


def test_html(spark):
    page = ("<html><head><title>T</title><script>x('<p>')</script></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy this, now.</div>"
            "<article><h1>Head &amp; line</h1><p>First  par,\nwith <b>bold</b> text.<p>Second &lt;par&gt;.<br>More.</article>"
            "<div class='comments'><p>Nice article, thanks, really.</p></div><footer>&copy; me</footer></body></html>")
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "just text"), (3, "w", "<article><p>cut &am")]
    out = rows_of(html_extract.query(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text", "n_chars")
    first = "Head & line\nFirst par, with bold text.\nSecond <par>. More."
    assert out == ordered([(1, first, len(first)), (2, "", 0), (None, "", 0), (3, "just text", 9), (3, "cut &am", 7)])


def test_html_keeps_all_of_the_article():
    par = "A long sentence of the article, with some marks, that goes on and on, until it ends. " * 4
    lines = [f"Par {k}. {par}".strip() for k in range(5)]
    pars = "".join(f"<p>{x}</p>" for x in lines)
    cells = [f"cell {k:05d}" for k in range(5)]
    items = [f"item {k:05d}" for k in range(60)]
    table = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in cells) + "</table>"
    list_ = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    nav = "<nav><a>Home</a></nav><div class='site-footer'>Imprint of the site.</div><div id='related-posts'><p>Read this, too.</p></div>"
    want = "\n".join(["Head", *lines, *cells, *items])
    for begin, end in (("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div class='content with-sidebar'>", "</div>"),
                       ("<div class='no-sidebar'><div>", "</div></div>"), ("", ""), ("<article class='post'><section>", "</section></article>")):
        page = f"<html><body>{nav}{begin}<h1>Head</h1>{pars}{table}{list_}{end}{nav}</body></html>"
        assert html_extract.main_text(page) == want, begin
    for name in ("ad", "ads ad-300", "left-sidebar", "comments-list", "cookie_banner", "social-links"):
        assert html_extract._names_other(name)
    for name in ("content with-sidebar", "no-sidebar", "social-science", "menu-recipe", "has-sidebar-left", ""):
        assert not html_extract._names_other(name)


def test_lm_scoring(make_docs, odd_rows):
    from pyspark.sql import functions as F
    low = lambda t: [bytes(x).lower() for x in words(t)]  # noqa: E731  ASCII letters only: bytes.lower
    train = [r for r in odd_rows if r[0] is not None and r[0] % 2]
    c = Counter(x for r in train for x in low(r[1]))
    ends, total = len(train), sum(c.values()) + len(train)
    den = total + 0.5 * (len(c) + 1 + 1)
    got = lm_scoring.score(make_docs(odd_rows), F.col("doc_id") % 2 == 1).collect()
    want = []
    for i, text, _ in odd_rows:
        w = low(text)
        base = sum(math.log10((c[x] + 0.5) / den) for x in w) + math.log10((ends + 0.5) / den)
        want.append((i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, round(base, 6)))
    assert ordered([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]) == ordered(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len(lm_scoring.score(make_docs(odd_rows), F.lit(False)).collect()) == len(odd_rows)


def test_most_frequent(spark):
    words = spark.createDataFrame([(k, k * k % 97) for k in range(500)] + [(1000 + k, 10 ** k) for k in range(9)], "key long, c long")
    rows = sorted(((r.key, r.c) for r in words.collect()), key=lambda r: (-r[1], r[0]))
    for limit in (1, 9, 40, 400, 600):
        assert [tuple(r) for r in lm_scoring.most_frequent(words, limit).collect()] == rows[:limit]
    assert lm_scoring.most_frequent(words.limit(0), 5).count() == 0


def test_unknown_words_are_spelled_like_rare_ones(make_docs):
    from pyspark.sql import functions as F
    rows = [(0, "zzz " * 3000, "a")] + [(i, " ".join(f"lo{x}mi{y}" for x in "abcdefgh" for y in "klmnopqr" if x + y != "cp"), "a") for i in range(2, 8, 2)]
    out = {r.doc_id: r.score for r in lm_scoring.score(make_docs(rows + [(1, "locmip", "a"), (3, "zzzzzz", "a")]), F.col("doc_id") % 2 == 0).collect()}
    assert out[1] > out[3]


def test_spelling_adds_up():
    import pyarrow as pa
    symbol, contexts, longest, size = lm_scoring.symbols(pa.array(["abab", "ab", "b"]))
    entries = Counter(int(e) for d in range(lm_scoring.DEPTH + 1) for e in lm_scoring._entry(d, contexts[d][longest >= d], symbol[longest >= d]))
    tree = SuffixTree(np.array(list(entries)), np.array(list(entries.values())))
    every = [bytes([x]).decode("latin-1") for x in range(33, 127)]
    begin = sum(10 ** tree.score(pa.array([x]))[0] for x in every)
    assert begin < 1.0 and tree.score(pa.array(["ab"]))[0] > tree.score(pa.array(["ba"]))[0]


def test_spelling_tree_is_never_cut(spark, make_docs, odd_rows):
    import pyarrow as pa
    from pyspark.sql import functions as F
    train = F.col("doc_id") % 2 == 1
    scores = [rows_of(lm_scoring.score(make_docs(odd_rows), train, hot=hot).withColumn("s", F.round("score", 6)), "doc_id", "s") for hot in (0, 20, 10 ** 6)]
    assert scores[0] == scores[1] == scores[2]
    # the table's probabilities are those of the tree in memory, built from all contexts that pass
    texts = sorted({f"{a}{b}{c}" for a in ("lo", "mi", "x") for b in "klmnopqr" for c in ("ta", "te", "u", "")})
    symbol, contexts, longest, size = lm_scoring.symbols(pa.array(texts))
    n = Counter(int(e) for d in range(lm_scoring.DEPTH + 1) for e in lm_scoring._entry(d, contexts[d][longest >= d], symbol[longest >= d]))
    kept, entries = lm_scoring.grow_tree(spark.createDataFrame(list(n.items()), "entry long, n long"), 2.0)
    assert {r.state for r in kept.collect()} == {r.entry >> 8 for r in entries.collect()} and 1 < kept.count() < len({e >> 8 for e in n})
    tree = SuffixTree(*[np.array(x) for x in zip(*[(r.entry, r.n) for r in entries.collect()])])
    asked = pa.array(["lokta", "mirte", "zz", "lo", "xku", "ÄÖ"])
    entry, size = lm_scoring._spellings(asked)
    spellings = spark.createDataFrame([(int(e), 1) for e in set(entry.tolist())], "key long, c long")
    found = {r.key: r.log_p for r in lm_scoring.spelling_probabilities(spellings, kept, entries).collect()}
    got = np.add.reduceat(np.array([found[e] for e in entry.tolist()]), np.cumsum(size) - size)
    assert np.allclose(got, tree.score(asked))


def test_empty_tables(spark, make_docs):
    docs = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (line_dedup.query(docs), token_output.query(docs), substring_dedup.query(docs), jaccard_join.query(docs), mixing.query(docs),
               quality_rules.query(docs), decontamination.query(docs, bench), classifier.query(docs, labels), html_extract.query(pages),
               lm_scoring.query(docs), jaccard_join.keep_representatives(docs), mixing.mixed(docs), decontamination.clean_documents(docs, bench)):
        assert df.count() == 0


def test_sql_queries(spark):
    import oracle_harness
    from deliverix.llm.queries import ORACLE_SQL
    found = oracle_harness.run_all(spark, "/root/testdata/sf0.01", sorted(ORACLE_SQL), verbose=False)
    assert {k: v for k, v in found.items() if not v.get("exact")} == {}
