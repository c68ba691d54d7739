"""Cases of the operators on repeated ids, very long texts, hot sources and hosts, against plain Python."""

import hashlib
import math
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deliverix.llm import classifier, decontamination, line_dedup, mixing, substring_dedup, token_output
from deliverix.llm.shared import CLEANUP, scratch_path, written

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def brute_lines(rows, max_ratio, min_pages):
    sites = {}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, text, site in rows:
        sites.setdefault(site, []).append({strip(x) for x in (text or "").split("\n")} - {""})
    bad = {s: {x for x, n in Counter(x for page in pages for x in page).items() if n >= min_pages and n > max_ratio * len(pages)} for s, pages in sites.items()}
    out = []
    for i, text, site in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if strip(x) not in bad[site]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return ordered(out)


def test_line_dedup_of_odd_rows(make_docs, odd_rows, monkeypatch):
    rows = odd_rows + [(20 + k, "\n".join(["menu", f"body {k}", "", " menu ", "foot\t", f"x{k % 2}"]), "c") for k in range(6)] + [(None, "menu\nfoot", "c"), (26, "menu\nfoot", "c")]
    for few in (64, 1, 0):  # lines compared in their row, or as rows of their own
        monkeypatch.setattr(line_dedup, "FEW", few)
        got = line_dedup.dedup_lines(make_docs(rows), max_ratio=0.4, min_pages=3).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert ordered(map(tuple, got)) == brute_lines(rows, 0.4, 3), few


def test_line_dedup_of_very_long_pages(make_docs):
    text = "\n".join(f"line {k}" for k in range(20_000))
    rows = [(k, text + f"\nown {k}", "a") for k in range(4)]
    got = line_dedup.dedup_lines(make_docs(rows), max_ratio=0.5, min_pages=3).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert ordered(map(tuple, got)) == [(k, 20_001, 20_000, f"own {k}") for k in range(4)]


def test_line_dedup_by_host(spark):
    hosts = {"https://User:x@Example.com:8080/a?b": "example.com", "http://[::1]:80/x": "[::1]", "ftp://h.org": "h.org", "no address": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in hosts], "url string")
    assert {r.url: r.h for r in df.select("url", line_dedup.host_of(F.col("url")).alias("h")).collect()} == hosts
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("lines", F.replace("html", F.lit("><"), F.lit(">\n<")))
    got = line_dedup.dedup_lines(pages, "page_id", line_dedup.host_of(F.col("url")), F.col("lines"), 0.2, 2).collect()
    want = brute_lines([(r.page_id, r.lines, re.match(r"[a-z]+://([^/:]*)", r.url)[1].lower()) for r in pages.collect()], 0.2, 2)
    assert ordered((r.page_id, r.n_lines, r.n_dropped, r.text) for r in got) == want
    assert sum(r.n_dropped for r in got) > 0


def test_cut_spans_by_row(spark, make_docs, odd_rows, monkeypatch):
    bench = spark.createDataFrame([(1, "short one"), (2, odd_rows[0][1]), (3, None), (4, "")], "item_id long, text string")
    docs = [(1, "clean words here"), (1, "Short ONE tail words"), (None, "short one"), (None, "a b c d e f"), (2, "x " + odd_rows[0][1] + " y"), (3, None), (4, "")]
    want = ordered([(1, "clean words here"), (1, "tail words"), (None, ""), (None, "a b c d e f"), (2, "x y"), (3, ""), (4, "")])
    for most in (10 ** 6, 20):  # all windows at once, or in parts
        got = decontamination.cut_spans(make_docs([(*d, "s") for d in docs]), bench, max_broadcast=most).select("doc_id", "text").collect()
        assert ordered(map(tuple, got)) == want


def test_classifier_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {k}") for k in range(3000)] + [(2, "good words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (None, 1), (4, 1), (3, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(classifier, "train", lambda rows: seen.append(rows) or classifier.Model)
    classifier.fit(docs, labels, sample=2)
    classifier.fit(docs.repartition(7), labels.repartition(3), sample=2)
    assert [len(rows) for rows in seen] == [2, 2]
    assert [[y for _, _, y in rows] for rows in seen] == [[0, 1]] * 2 or [[y for _, _, y in rows] for rows in seen] == [[1, 0]] * 2  # the smallest label
    assert all((a == b).all() for x, y in zip(*seen) for a, b in zip(x[:2], y[:2]))  # and one text, whatever the partitions


def test_classifier_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in classifier.score(docs, classifier.fit(docs, none)).collect()] == [0.5] * 3
    assert classifier.query(docs.limit(0), none).collect() == []


def brute_mix(rows):
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
    taken = []
    for s in order:
        keyed = []
        for i, text, source in rows:
            if source == s:
                t = text or ""
                weight = max(0.05, sum(c not in "#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) / len(t) if t else 0.05)
                u = (int(hashlib.md5(f"{'' if i is None else i}#mix-1#{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                keyed.append((-math.log(u) / weight, i, len(words(t))))
        keyed.sort(key=lambda k: (k[0], k[1] is not None, k[1] or 0))
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, used = target[s] - epochs * sizes[s], 0
        for _, i, n in keyed:
            taken.append((i, n, n * (epochs + (n > 0 and used + n / 2 <= rest))))
            used += n
    return ordered(taken)


@pytest.mark.parametrize("bin_docs", [2000, 10, 1])
def test_mixing_against_brute_force(make_docs, odd_rows, bin_docs):
    """Heavy and light weights, sources of all sizes, rows of one id, copies, one very long text; any size of bins."""
    rows = odd_rows + [(k, ("CAPITALS " if k % 3 else "small ") * (1 + k % 9), "hot") for k in range(700)]
    rows += [(None, f"null id {k}", "hot") for k in range(300)] + [(5, "same row", "hot")] * 90 + [(6000 + k, "w", None) for k in range(40)]
    got = mixing.mix(make_docs(rows), bin_docs=bin_docs).select("doc_id", "size", "taken").collect()
    assert ordered(map(tuple, got)) == brute_mix(rows)


def test_mixed_rows_match_their_decisions(make_docs):
    rows = [(k % 50, f"text {k % 80} " * (1 + k % 4), "ab"[k % 2]) for k in range(400)] + [(None, "again", None)] * 7
    docs = make_docs(rows)
    copies = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(docs).collect())
    size = lambda t: len(words(t))
    taken = Counter()
    for i, n, t in brute_mix(rows):
        taken[i] += t
    got = Counter()
    for (i, text, _), n in copies.items():
        got[i] += n * size(text)
    assert got == +taken
    assert mixing.mixed(docs).columns == docs.columns and mixing.query(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_tokens_of_one_id_are_spread_and_in_order(spark, make_docs):
    rows = [(None, f"row {k}", "s") for k in range(400)] + [(7, f"seven {k}", "s") for k in range(400)] + [(1, "one", "s"), (9, "nine", "s")]
    path = scratch_path(spark, "spread")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_output.write_tokens(make_docs(rows).repartition(6), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    per = spark.read.parquet(f"{path}/index").groupBy("id").agg(F.count_distinct("shard").alias("shards")).collect()
    assert all(r.shards > 1 for r in per if r.id in (None, 7))
    placed = spark.read.parquet(f"{path}/index").orderBy(token_output.shard_place(F.col("shard")), "offset").collect()
    ids = [r.id for r in placed]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(d).glob("*/shuffle_*")}


def left_over(spark, before):
    """Shuffle files that are still there; Spark removes them in the background."""
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    return left


def test_written_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert left_over(spark, before) == set()
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6
    assert spark.conf.get(CLEANUP, None) == setting


def test_substring_dedup_leaves_no_shuffle_files_behind_its_steps(spark, make_docs, odd_rows):
    before = shuffle_files(spark)
    out = substring_dedup.remove_repeats(make_docs(odd_rows))
    assert left_over(spark, before) == set()  # the texts are shuffled when the result is read
    assert out.count() == len(odd_rows)


def test_classifier_sample_reaches_the_driver_packed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "few words here"), (2, "again " * 300), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(classifier, "train", lambda rows: seen.extend(rows) or classifier.Model)
    classifier.fit(docs, labels)
    assert {(len(b) > 0, c.itemsize, y) for b, c, y in seen} == {(True, 1, 1), (True, 4, 0), (False, 1, 1)}
    for text, y in (("few words here", 1), ("again " * 300, 0)):
        want = np.unique(classifier.features(pa.array([text]))[0], return_counts=True)
        (got,) = [(b, c) for b, c, label in seen if label == y and len(b)]
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
