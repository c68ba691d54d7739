"""Operator 10: language-model scores by a probabilistic suffix tree.

The model reads a text as tokens: words, then one end.  Two levels of contexts:

* Tokens (module ``token_tree``).  The root predicts a token from the training
  counts, and with the weight of the number of distinct words a word that is
  spelled.  From the longest retained suffix of up to two tokens before it
  (the text's beginning is a token) a tree of contexts corrects that.
* Spelling.  A word's bytes and closing blank are predicted one after another
  from the longest retained suffix, up to ``DEPTH`` symbols, of what precedes
  them in the word (its beginning is a symbol).

A context is retained if its next-symbol counts diverge from its parent's: n *
KL at least ``MIN_DIVERGENCE``; a retained context's parents are retained.
Spelling distributions are smoothed towards the parent's with the weight of the
number of distinct next symbols, at the root towards 256 equal symbols; each
adds up to one.

The spelling learns from the distinct words, each once: what it has to tell is
how words look that were not seen, and those look like the rare ones.

Scale: words are counted in one pass (map-side combined), spelling counts come
from the vocabulary.  The spelling tree is a table that keeps every context which passes
the one divergence test, and its probabilities are joined to the distinct
(context, symbol) pairs of the vocabulary; the ``HOT`` pairs that most words
have, a fixed number, are broadcast (16 bytes a pair), the others of a word
are joined.  Words are scored once each, where the vocabulary is.  The ``FREQUENT`` most
frequent words, a fixed number, are broadcast; what is not meets the documents by
parts (module ``cold_scores``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm import cold_scores, token_tree
from deliverix.llm.shared import NULL_ID, Words, expand, fold_of, id_key, mix, signed, summed, text_slices, written

DEPTH = 5
MIN_DIVERGENCE = 8.0
HOT = 1_000_000
FREQUENT = 1 << 16
BLANK = 32
#: Bytes of the vocabulary whose words are spelled at once: about 100 bytes of arrays per byte.
SPELLED = 1 << 20


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow string array."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(raw[expand(start, size)].tobytes()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) to (key, word, n): occurrences in training texts by word."""
    return summed(_counted_words(batches))


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for b in text_slices(batches, "text"):
        w = Words(b.column("text"), lower=True)
        key, first, code = np.unique(w.hash, return_index=True, return_inverse=True)
        train = np.repeat(b.column("train").to_numpy(zero_copy_only=False).astype(np.float64), w.counts)
        n = np.bincount(code, weights=train, minlength=len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        yield key, pa.record_batch([pa.array(signed(key)), _strings(w.raw, w.start[first], w.end[first]), pa.array(n)], names=["key", "word", "n"])


def symbols(words: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of all symbols to predict: the symbol, its contexts of length 0..DEPTH as integers, the
    longest length there is, and the number of symbols of each word."""
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(off) + 2
    ends = np.cumsum(size)
    padded = np.full(int(ends[-1]) if len(ends) else 0, BLANK, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    padded[expand(ends - size + 1, size - 2)] = raw[expand(off[:-1], size - 2)]
    at = expand(ends - size + 1, size - 1)
    place = at - np.repeat(ends - size, size - 1)
    contexts = [np.zeros(len(at), np.int64)]
    for d in range(1, DEPTH + 1):
        contexts.append(contexts[-1] | padded[np.maximum(at - d, 0)] << (8 * (d - 1)))
    return padded[at], contexts, np.minimum(place, DEPTH), size - 1


def _entry(d: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (np.int64(d) << 48) | (context << 8) | symbol


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (entry, n): how often each symbol follows each context."""
    return summed(_counted_contexts(batches))


def _counted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for b in token_tree.whole(batches, SPELLED):
        for at in range(0, b.num_rows, 100_000):
            part = b.slice(at, 100_000)
            symbol, contexts, longest, size = symbols(part.column("word"))
            n = np.repeat(part.column("n").to_numpy(), size)
            for d in range(DEPTH + 1):
                has = longest >= d
                entry, code = np.unique(_entry(d, contexts[d][has], symbol[has]), return_inverse=True)
                total = np.bincount(code, weights=n[has].astype(np.float64), minlength=len(entry))
                yield entry, pa.record_batch([pa.array(entry), pa.array(total.astype(np.int64))], names=["entry", "n"])


def _spellings(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all symbols of the words: the entry of its longest context, and the number of symbols of each word."""
    symbol, contexts, longest, size = symbols(words)
    return _entry(longest, np.stack(contexts)[longest, np.arange(len(symbol))], symbol), size


def _count_spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) to (key, c): in how many places of words each symbol stands behind its longest context."""
    return summed(_counted_spellings(batches))


def _counted_spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for b in token_tree.whole(batches, SPELLED):
        for at in range(0, b.num_rows, 100_000):
            entry, c = np.unique(_spellings(b.column("word").slice(at, 100_000))[0], return_counts=True)
            yield entry, pa.record_batch([pa.array(entry), pa.array(c)], names=["key", "c"])


def grow_tree(counts: DataFrame, min_divergence: float = MIN_DIVERGENCE) -> tuple[DataFrame, DataFrame]:
    """The tree from (entry, n): tables of its contexts (state, total, kinds) and of their entries (entry, n).

    Divergence tests are joins of contexts with their parents; every context
    that passes is kept, and the contexts above it.
    """
    d, context = F.shiftright("entry", 48), F.shiftright("entry", 8)
    e = counts.select("entry", "n", d.alias("d"), context.alias("state"), F.col("entry").bitwiseAND(255).alias("x"))
    totals = written(e.groupBy("state").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "context-totals")
    e = e.join(totals.select("state", "total"), "state")
    masks = F.element_at(F.array(*[F.lit((1 << 8 * max(k - 1, 0)) - 1) for k in range(DEPTH + 1)]), (F.col("d") + 1).cast("int"))
    parent = F.shiftleft((F.col("d") - 1).cast("long"), 40).bitwiseOR(F.col("state").bitwiseAND(masks))
    child = e.where("d > 0").withColumn("parent", parent).alias("c")
    upper = e.select("state", "x", F.col("n").alias("pn"), F.col("total").alias("ptotal")).alias("p")
    gain = F.col("c.n") * F.log(F.col("c.n") * F.col("ptotal") / (F.col("c.total") * F.col("pn")))
    states = (child.join(upper, (F.col("c.parent") == F.col("p.state")) & (F.col("c.x") == F.col("p.x")))
              .groupBy("c.state").agg(F.sum(gain).alias("divergence")).where(F.col("divergence") >= min_divergence))
    depth = F.shiftright("state", 40)
    above = F.array(*[F.when(depth >= k, F.col("state").bitwiseAND((1 << 8 * k) - 1).bitwiseOR(F.lit(k << 40))) for k in range(DEPTH + 1)])
    kept = states.select(F.explode(above).alias("state")).where("state IS NOT NULL").union(
        counts.sparkSession.range(1).select(F.col("id").alias("state"))).distinct()  # the root is 0
    kept = written(totals.join(kept, "state", "left_semi"), "contexts")
    return kept, written(counts.withColumn("state", context).join(kept.select("state"), "state", "left_semi").select("entry", "n"), "entries")


def spelling_probabilities(spellings: DataFrame, contexts: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, c) of symbols behind their longest contexts, with log_p: from the root down, what each retained context makes of it."""
    out = spellings.withColumn("p", F.lit(1 / 256))
    for d in range(DEPTH + 1):
        state = F.shiftright("key", 8).bitwiseAND((1 << 8 * d) - 1).bitwiseOR(F.lit(d << 40))
        out = out.withColumn("at", F.when(F.shiftright("key", 48) >= d, state))
        out = out.withColumn("at_entry", F.shiftleft("at", 8).bitwiseOR(F.col("key").bitwiseAND(255)))
        s = contexts.where(F.shiftright("state", 40) == d)
        e = entries.where(F.shiftright("entry", 48) == d).select("entry", "n")
        if d < 2:  # 256 contexts of 256 symbols at most
            s, e = F.broadcast(s), F.broadcast(e)
        out = out.join(s, out["at"] == s["state"], "left").join(e, out["at_entry"] == e["entry"], "left")
        p = (F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("total") + F.col("kinds"))
        out = out.select("key", "c", F.when(F.col("total").isNull(), F.col("p")).otherwise(p).alias("p"))
    return out.select("key", "c", F.log10("p").alias("log_p"))


class HotSpellings:
    """The most frequent entries and their log10 probabilities."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray):
        self.keys, self.log_p = keys, log_p

    @cached_property
    def index(self) -> token_tree.Index:
        """Made where it is used; scrambled, because entries share their leading bits."""
        return token_tree.Index(mix(self.keys.view(np.uint64)))

    def find(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.index.find(mix(entry.view(np.uint64)))


def _spell(hot) -> callable:
    """(key, word, c) to (key, c, spell, rest): the log10 probability of the hot symbols, and the other symbols of each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for b in token_tree.whole(batches, SPELLED):
            for at in range(0, b.num_rows, 100_000):
                part = b.slice(at, 100_000)
                entry, size = _spellings(part.column("word"))
                k, has = known.find(entry)
                values = np.zeros(len(entry))
                values[has] = known.log_p[k[has]]
                first = np.cumsum(size) - size
                off = np.concatenate([[0], np.cumsum(np.add.reduceat((~has).astype(np.int64), first))]) if len(size) else np.zeros(1)
                yield pa.record_batch([
                    part.column("key"), part.column("c"), pa.array(np.add.reduceat(values, first) if len(size) else values),
                    pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(entry[~has]))], names=["key", "c", "spell", "rest"])
    return run


def score_words(vocabulary: DataFrame, spellings: DataFrame, total: int, kinds: int, hot: int = HOT) -> DataFrame:
    """(key, c, log_p) of each word: its training count's share, and with the root's weight of new words its spelling."""
    top = most_frequent(spellings, hot).select("key", "log_p").orderBy("key").toArrow()  # hot rows at most
    shared = vocabulary.sparkSession.sparkContext.broadcast(HotSpellings(top.column("key").to_numpy(), top.column("log_p").to_numpy()))
    spelled = written(vocabulary.select("key", "word", "c").mapInArrow(_spell(shared), "key long, c long, spell double, rest array<long>"), "spelled-words")
    rest = spelled.where(F.size("rest") > 0).select(F.col("key").alias("word_key"), F.col("c").alias("word_c"), "spell", F.explode("rest").alias("key"))
    rest = (rest.join(spellings.select("key", "log_p"), "key").groupBy("word_key", "word_c", "spell").agg(F.sum("log_p").alias("more"))
            .select(F.col("word_key").alias("key"), F.col("word_c").alias("c"), (F.col("spell") + F.col("more")).alias("spell")))
    words = spelled.where(F.size("rest") == 0).select("key", "c", "spell").unionByName(rest)
    spell = F.col("spell") + F.lit(float(np.log10(kinds / (total + kinds))) if total else 0.0)
    known = F.log10(F.greatest(F.col("c").cast("double"), F.lit(1e-300)) / float(total + kinds)) if total else F.lit(-300.0)
    words = words.select("key", "c", spell.alias("spell"), known.alias("known")).withColumn("high", F.greatest("known", "spell"))
    both = F.pow(F.lit(10.0), F.col("known") - F.col("high")) + F.pow(F.lit(10.0), F.col("spell") - F.col("high"))
    return words.select("key", "c", (F.col("high") + F.log10(both)).alias("log_p"))


class Frequent:
    """The most frequent words: sorted keys, and by key their counts and log10 probabilities."""

    def __init__(self, keys: np.ndarray, c: np.ndarray, log_p: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.c, self.log_p = keys[order], c[order], log_p[order]

    @cached_property
    def index(self) -> token_tree.Index:
        """Made where it is used."""
        return token_tree.Index(self.keys)


def most_frequent(words: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of the largest ``c``, ties by key.

    A histogram of the counts (16 bins per power of two, so some hundred rows)
    says from which bin on there are enough rows; only those are ordered.
    """
    size = F.when(F.col("c") > 0, F.floor(F.log2("c") * 16).cast("int")).otherwise(-1)
    bins = sorted(words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, n = -1, 0
    for b in bins:
        least, n = b["size"], n + b["n"]
        if n >= limit:
            break
    return words.where(size >= least).orderBy(F.col("c").desc(), "key").limit(limit)


def score(documents: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
          frequent: int = FREQUENT, min_divergence: float = MIN_DIVERGENCE, hot: int = HOT,
          min_count: int = token_tree.MIN_COUNT, min_pair: int = token_tree.MIN_PAIR, hot_contexts: int = token_tree.HOT) -> DataFrame:
    """Score every row; learn from the rows where the column ``train`` is true.

    Returns (id, train, n_tokens, n_known, train_tokens, base_score, score):
    words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end; base_score
    is the add-half unigram model's log10 probability, score the tree's.  A
    null or wordless text is one end.  Without training rows all counts are
    0 (score: equal symbols).  Rows that repeat an
    id and a text are scored each, and counted each in training.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(id_key(F.col(id_col)).alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    ends = docs.where("train").count()
    vocabulary = written(docs.select("train", "text").mapInArrow(_count_words, "key long, word string, n long")
                         .groupBy("key", "word").agg(F.sum("n").alias("c")), "vocabulary")
    seen = vocabulary.where("c > 0")
    total, kinds = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = total + ends, kinds + (ends > 0)
    counts = written(seen.select("word", F.lit(1).cast("long").alias("n")).mapInArrow(_count_contexts, "entry long, n long")
                     .groupBy("entry").agg(F.sum("n").alias("n")), "context-counts")
    spark = documents.sparkSession
    spellings = vocabulary.select("word").mapInArrow(_count_spellings, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    spellings = written(spelling_probabilities(written(spellings, "spellings"), *grow_tree(counts, min_divergence)), "spelling-scores")
    scored = written(score_words(vocabulary, spellings, total, kinds, hot), "scored-words")
    top = most_frequent(scored, frequent).toArrow()
    top = Frequent(*[top.column(x).to_numpy() for x in ("key", "c", "log_p")])
    end = ends / (total + kinds) if ends else 1.0
    tree = token_tree.grow(docs.where("train").select("text"), scored, ends, end, min_divergence, min_count, min_pair)
    hot_tree = tree.hot(hot_contexts)
    model = spark.sparkContext.broadcast((top, hot_tree))
    one = cold_scores.sums_of_texts(docs.select("doc", "text"), model, hot_tree, tree, scored, total)
    n = F.col("n").cast("long") + 1
    return one.select(
        F.nullif(F.col("doc"), F.lit(NULL_ID)).cast(kind).alias(id_col),
        n.alias("n_tokens"), (F.col("known").cast("long") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(float(np.log10(ends + 0.5))) - n * F.lit(float(np.log10(total + 0.5 * (kinds + 1))))).alias("base_score"),
        (F.col("log_p") + F.lit(float(np.log10(end)))).alias("score"))


def query(documents: DataFrame) -> DataFrame:
    held = fold_of(F.col("doc_id")) == 1
    out = score(documents, ~held)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
                      "n_tokens", "n_known", "train_tokens", "base_score", "score")
