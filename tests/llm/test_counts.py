"""Counts of a task reach Spark put together, whatever batches and slices the rows came in."""

from collections import Counter

import numpy as np
import pyarrow as pa

from deliverix.llm import lm_scoring, token_tree
from deliverix.llm.shared import HANDED, HASH_BYTES, Prefix, Words, signed, summed


def rows_of(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def test_equal_keys_are_one_row():
    rng = np.random.default_rng(5)
    parts = []
    for _ in range(40):
        x, n = np.unique(rng.integers(-30, 30, 50), return_counts=True)
        parts.append((x.view(np.uint64), pa.record_batch([pa.array(x), pa.array([f"w{i}" for i in x]), pa.array(n)], names=["key", "word", "n"])))
    want = Counter()
    for _, b in parts:
        for r in b.to_pylist():
            want[r["key"], r["word"]] += r["n"]
    assert sorted(rows_of(summed(iter(parts)))) == sorted((*k, n) for k, n in want.items())
    few = rows_of(summed(iter(parts), held=70))  # most are given up at once
    assert len(few) > len(want) and sum(r[2] for r in few) == 40 * 50 and {r[:2] for r in few} == set(want)
    assert rows_of(summed(iter([]))) == []
    many = np.arange(HANDED + 5)
    assert [b.num_rows for b in summed(iter([(many, pa.record_batch([pa.array(many), pa.array(many)], names=["key", "n"]))]))] == [HANDED, 5]


def test_a_task_counts_each_word_and_context_once():
    texts = [f"Common word{i % 700} odd{i}" for i in range(3000)] + ["", "long " * 300_000, "common Common Ä ä"]
    batches = [pa.record_batch([pa.array([i % 2 == 0 for i in range(at, at + len(part))]), pa.array(part)], names=["train", "text"])
               for at in range(0, len(texts), 1000) for part in [texts[at:at + 1000]]]
    want = Counter()
    for i, t in enumerate(texts):
        for w in t.split():
            want["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)] += i % 2 == 0
    got = rows_of(lm_scoring._count_words(iter(batches)))
    assert sorted((word, n) for _, word, n in got) == sorted(want.items())
    words = sorted(want)
    parts = [pa.record_batch([pa.array(words[at:at + 100]), pa.array([1] * len(words[at:at + 100]))], names=["word", "n"]) for at in range(0, len(words), 100)]
    symbol, contexts, longest, _ = lm_scoring.symbols(pa.array(words))
    entries = Counter(int(e) for d in range(lm_scoring.DEPTH + 1) for e in lm_scoring._entry(d, contexts[d][longest >= d], symbol[longest >= d]))
    assert sorted(rows_of(lm_scoring._count_contexts(iter(parts)))) == sorted(entries.items())
    spelled = Counter(lm_scoring._spellings(pa.array(words))[0].tolist())
    assert sorted(rows_of(lm_scoring._count_spellings(iter(parts)))) == sorted(spelled.items())


def test_a_task_counts_each_run_once():
    texts = ["a b c " * 200_000, "a b", "", "c a b " * 300_000]
    batches = [pa.record_batch([pa.array([t])], names=["text"]) for t in texts]

    class Shared:  # every token and context may be frequent
        value = (np.full(token_tree.LONGS, -1),) * 2

    for d in (1, 2):
        want = Counter()
        for t in texts:
            _, token, before, there, _ = token_tree.runs(Words(pa.array([t]), lower=True))
            want.update(zip(signed(before[d - 1][there[d - 1]]).tolist(), signed(token[there[d - 1]]).tolist()))
        got = rows_of(token_tree._count(Shared, d)(iter(batches)))
        assert sorted(got) == sorted((*k, n) for k, n in want.items())


def test_hashes_do_not_depend_on_their_place():
    rng = np.random.default_rng(7)
    words = ["x" * 3 * HASH_BYTES, "y"] + ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 40, 9000)]
    w = Words(pa.array([" ".join(words), "", "  ", "one two"]))
    assert (w.hash == Prefix(w.raw.astype(np.uint64) + np.uint64(1)).ranges(w.start, w.end)).all()
    assert w.hash.tolist() == [int(Words(pa.array([x])).hash[0]) for x in [*words, "one", "two"]]
    assert len(Words(pa.array(["", " "])).hash) == len(Words(pa.array([], pa.string())).hash) == 0


def test_hot_spellings_are_found():
    entry, _ = lm_scoring._spellings(pa.array([f"lo{x}mi{y}" for x in "abcdefgh" for y in "klmnopqr"]))
    keys = np.unique(entry)[::2]
    hot = lm_scoring.HotSpellings(keys, np.arange(len(keys)) + 0.0)
    at, has = hot.find(entry)
    assert (has == np.isin(entry, keys)).all() and (keys[at[has]] == entry[has]).all()
    assert not lm_scoring.HotSpellings(keys[:0], np.zeros(0)).find(entry)[1].any()
