"""Operator 3: repeated passages by De Bruijn compaction.

Edges of the graph are windows of ``WINDOW`` words (the k-mers), nodes are the
windows' overlaps.  Window by window the graph of a corpus has as many edges
as the corpus has words, so it is compacted before anything is shuffled, as
minimizer-based compaction does: consecutive windows of a document that share
their minimizer (the smallest hash among their runs of ``CORE`` words) form one
nonbranching piece of a path, kept as one row (document, start, windows,
minimizer, content hash).  Equal windows have equal minimizers at equal
places, so whatever repeats meets under its minimizer:

1. minimizers that occur twice or more are counted, and pieces are joined to them;
2. equal pieces are one path: all occurrences but the first are repeats, window by window;
3. where several different pieces share a minimizer the path branches, and only
   there single windows (128-bit keys) are compared, once per distinct piece;
4. source coordinates (document, start) of what repeats are joined to the texts,
   where overlapping spans merge.  That words are equal rests on 128 bits of
   keys (minimizer and content, or two of a window), not on a comparison of words.

Scale: every shuffle carries pieces (about one per 8 words), not words; the
text moves by document once.  Counting is map-side combined; both sides of
the joins on minimizers and pieces come from written tables, so adaptive
execution can split a hot passage.  Nothing is gathered but the spans of one document.
Each step ends in a written table, and its shuffle files go with it, so the disk
holds the tables (pieces, repeats, paths, windows, spans) and one step's shuffle at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.shared import Prefix, Words, expand, id_key, mix, signed, text_slices, written

WINDOW = 20
CORE = 6


def _pieces(window: int, core: int):
    """Arrow: (doc, th, text) to one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            w = Words(b.column("text"))
            at = w.windows(window)
            if not len(at):
                continue
            x = mix(w.hash, 2)
            prefix = Prefix(x)
            n = len(w)
            starts = np.arange(n - core + 1)
            cores = prefix.ranges(starts, starts + core, 3)
            best, place = cores[at], at.copy()
            for d in range(1, window - core + 1):
                c = cores[at + d]
                less = c < best
                best[less], place[less] = c[less], (at + d)[less]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(place) != 0) | (np.diff(at) != 1)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            start = at[first]
            doc = np.searchsorted(w.at, start, side="right") - 1
            content = Prefix(mix(w.hash, 4)).ranges(start, start + size + (window - 1), 5)
            take = pa.array(doc)
            yield pa.record_batch([
                b.column("doc").take(take), b.column("th").take(take),
                pa.array(((start - w.at[doc]) << 6) | size, pa.int64()),
                pa.array(signed(best[first])), pa.array(signed(content))], names=["doc", "th", "place", "m", "h"])
    return run


def _windows(window: int):
    """Arrow: (doc, th, text, places) to the keys of all windows of the pieces at those places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            w = Words(b.column("text"))
            lists = b.column("places")
            place = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            size = place & 63
            at = expand(w.at[doc] + (place >> 6), size)
            doc = np.repeat(doc, size)
            a = Prefix(mix(w.hash, 6)).ranges(at, at + window, 7)
            c = Prefix(mix(w.hash, 8)).ranges(at, at + window, 9)
            take = pa.array(doc)
            yield pa.record_batch([b.column("doc").take(take), b.column("th").take(take), pa.array(at - w.at[doc], pa.int64()),
                                   pa.array(signed(a)), pa.array(signed(c))], names=["doc", "th", "start", "a", "c"])
    return run


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (id as a non-null long), th (hash of the text), id, text (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(id_key(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("th"), F.col(id_col).alias("id"), text.alias("text"))


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, core: int = CORE) -> DataFrame:
    """(doc, th, start, words): spans of words covered by windows that also start earlier, not yet merged.

    Earlier: in a smaller id (null is the smallest), or in the same id at a
    smaller word position.  Rows that repeat an id and a text are one
    document; rows of one id with different texts share its coordinates.
    """
    docs = keyed(documents, id_col, text_col)
    text = docs.select("doc", "th", "text")
    pieces = written(text.mapInArrow(_pieces(window, core), "doc long, th long, place long, m long, h long"), "pieces")
    again = written(pieces.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m"), "minimizers")
    # rows that repeat id and text give equal pieces; as coordinates they are one
    found = written(pieces.join(again, "m"), "repeats")
    where = F.struct("doc", F.shiftright("place", 6).alias("start"), F.col("place").bitwiseAND(63).alias("size"), "th")
    paths = written(found.groupBy("m", "h").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")), "paths")
    copies = (found.join(paths.where("n > 1").select("m", "h", F.col("first.doc").alias("d0"), F.col("first.start").alias("s0")), ["m", "h"])
              .where((F.col("doc") != F.col("d0")) | (F.shiftright("place", 6) != F.col("s0")))
              .select("doc", "th", F.shiftright("place", 6).alias("start"),
                      (F.col("place").bitwiseAND(63) + F.lit(window - 1)).alias("words")))
    # branching: one minimizer, several paths; their windows are compared at each path's first place
    several = paths.groupBy("m").agg(F.count(F.lit(1)).alias("n_paths")).where("n_paths > 1").select("m")
    branch = paths.join(written(several, "branching"), "m").select(
        F.col("first.doc").alias("doc"), F.col("first.th").alias("th"),
        (F.shiftleft("first.start", 6) + F.col("first.size")).alias("place"))
    places = branch.groupBy("doc", "th").agg(F.collect_list("place").alias("places"))  # of one document
    # rows that repeat an id and a text are windowed once each; equal coordinates change nothing
    keys = written(text.join(places, ["doc", "th"]).mapInArrow(_windows(window), "doc long, th long, start long, a long, c long"), "windows")
    firsts = keys.groupBy("a", "c").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("a", "c", F.col("first.doc").alias("d0"), F.col("first.start").alias("s0")), "first-windows")
    single = (keys.join(firsts, ["a", "c"]).where((F.col("doc") != F.col("d0")) | (F.col("start") != F.col("s0")))
              .select("doc", "th", "start", F.lit(window).cast("long").alias("words")))
    return copies.unionByName(single)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to the words that stay."""
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            n_words, texts = [], []
            for text, spans in zip(part.column("text"), part.column("spans")):
                words = text.as_buffer().to_pybytes().split()
                n_words.append(len(words))
                if spans.is_valid and len(words):
                    edge = np.zeros(len(words) + 1, np.int64)
                    place = spans.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, place >> 32, 1)
                    np.add.at(edge, (place >> 32) + (place & 0xFFFFFFFF), -1)
                    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in keep.tolist()]
                texts.append((len(words), b" ".join(words)))
            yield pa.record_batch([part.column("id"), pa.array(n_words, pa.int64()),
                                   pa.array([n - t[0] for n, t in zip(n_words, texts)], pa.int64()),
                                   pa.array([t[1].decode() for t in texts], pa.string())], names=["id", "n_words", "n_removed", "text"])


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, core: int = CORE) -> DataFrame:
    """(id, n_words, n_removed, text) of every row: the words outside repeated spans, joined by one space.

    Windows are judged on the input, not on what is left.  A null or wordless
    text has no words; shorter texts than a window keep all.  Very long texts are
    read whole.  Rows that repeat an id share its coordinates;
    rows equal in id and text are one document.  An empty table gives an empty one;
    other columns, whatever their names, are not looked at.
    """
    spans = repeated_spans(documents, id_col, text_col, window, core)
    spans = spans.groupBy("doc", "th").agg(F.collect_set(F.shiftleft("start", 32) + F.col("words")).alias("spans"))  # of one document
    spans = written(spans, "spans")  # the shuffles of repeats are gone before the texts are shuffled
    docs = keyed(documents, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()
    return (docs.join(spans, ["doc", "th"], "left").select("id", "text", "spans")
            .mapInArrow(_keep, f"id {kind}, n_words bigint, n_removed bigint, text string")
            .withColumnsRenamed({"id": id_col, "text": text_col}))


def query(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
