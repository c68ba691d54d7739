"""Lookups of words and contexts that are not broadcast: bytes a token, blocks and parts against a dictionary."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deliverix.llm import lm_scoring, token_tree
from deliverix.llm.shared import Words, signed
from deliverix.session import ensure_checkpoint_dir


def scratch_bytes(spark, name):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    top = "/" + top.lstrip("/")
    return {d: sum(os.path.getsize(os.path.join(p, f)) for p, _, files in os.walk(os.path.join(top, d)) for f in files)
            for d in os.listdir(top) if d.startswith(f"llm-{name}-")}


def test_tokens_in_contexts_that_are_not_broadcast_are_not_rows_on_disk(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(1500)), "a") for k in range(80)]
    before = scratch_bytes(spark, "document-sums")
    out = lm_scoring.score(make_docs(rows), F.col("doc_id") % 2 == 0, min_divergence=0.1, min_count=8, min_pair=4, hot_contexts=0)
    assert out.count() == len(rows)
    after = scratch_bytes(spark, "document-sums")
    assert sum(n for d, n in after.items() if d not in before) < 80 * 1500  # a byte a token


@pytest.fixture
def texts():
    rng = random.Random(8)
    return [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "w1"]


def asked(texts, monkeypatch, parts, held):
    """What ``answer`` and the blocks make of the texts, and by hand: nothing is broadcast but w0; every second word is a context."""
    from deliverix.llm import cold_scores

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(cold_scores, "TaskContext", Task)
    key = {f"w{k}": Words(pa.array([f"w{k}"])).hash[0] for k in range(61)}
    contexts = {key[f"w{k}"]: -0.5 - k for k in range(0, 61, 2)}
    longer = {token_tree.run_key(np.array([a]), np.array([b]))[0]: (-7.0, b) for a in list(key.values())[:20] for b in list(contexts)[:10]}
    entries = {(c, x): 0.25 for c in contexts for x in list(key.values())[::3]} | {(c, token_tree.END): 3.0 for c in longer}
    run = {k: token_tree.run_key(np.array([k[0]]), np.array([k[1]]))[0] for k in entries}
    none = np.zeros(0)
    hot = token_tree.HotTree(none.astype(np.int64), none, none.astype(np.int64), none, np.full(token_tree.LONGS, -1), None)
    w0 = signed(np.array([key["w0"]]))

    class Model:
        value = (lm_scoring.Frequent(w0, np.array([5]), np.array([-1.0])), hot)

    place = lambda c: c if c in contexts else longer[c][1]
    model = ([(place(c), c, b, 0, 0) for c, b in contexts.items()] + [(place(c), c, b, 0, 0) for c, (b, _) in longer.items()]
             + [(place(k[0]), run[k], g, 0, 1) for k, g in entries.items()] + [(x, x, -0.1 * i, i % 4, 2) for i, x in enumerate(key.values())])
    messages = []
    for p in range(parts):
        rows = [r for r in model if int(r[0]) & (parts - 1) == p]
        if rows:
            _, k, value, c, kind = zip(*rows)
            messages += cold_scores._pack_model(pa.table({"part": [p] * len(rows), "key": signed(np.array(k, np.uint64)), "value": value, "c": c, "kind": kind})).to_batches()
    docs = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    messages += list(cold_scores.ask(Model, parts, held)(iter([docs.slice(0, 90), docs.slice(90)])))
    rows = pa.Table.from_batches(messages).sort_by([("part", "ascending"), ("kind", "ascending")])
    answers = pa.Table.from_batches(list(cold_scores.answer(iter(rows.to_batches(max_chunksize=7)))))
    want = {}
    for t, text in enumerate(texts):
        tokens = [key[x] for x in text.split()]
        known, logs, log_p = 0, 0.0, 0.0
        for x in tokens:
            i = list(key.values()).index(x)
            c, p = (5, -1.0) if i == 0 else (i % 4, -0.1 * i)
            known, logs, log_p = known + (c > 0), logs + np.log10(c + 0.5), log_p + p
        run_of = [token_tree.BEGIN, *tokens, token_tree.END]
        for i in range(1, len(run_of)):
            g, c1 = 0.0, run_of[i - 1]
            if c1 in contexts:
                g = entries.get((c1, run_of[i]), contexts[c1])
                c2 = token_tree.run_key(np.array([run_of[i - 2]]), np.array([c1]))[0] if i > 1 else None
                if c2 in longer:
                    g = entries.get((c2, run_of[i]), longer[c2][0] + g)
            log_p += g
        want[t] = (len(tokens), known, pytest.approx(logs, abs=1e-9), pytest.approx(log_p, abs=1e-9))
    return answers, want


@pytest.mark.parametrize("parts,held", [(1, 10 ** 6), (8, 10 ** 6), (8, 50)])
def test_blocks_and_parts_change_nothing(texts, monkeypatch, parts, held):
    from deliverix.llm import cold_scores
    answers, want = asked(texts, monkeypatch, parts, held)
    blocks = sorted(set(answers.column("block").to_pylist()))
    assert len(blocks) == (2 if held == 50 else 1)  # a block ends with a batch
    got = {}
    for b in blocks:
        t = cold_scores._texts(answers.filter(pa.compute.equal(answers.column("block"), b)))
        got |= {r["doc"]: (r["n"], r["known"], r["logs"], r["log_p"]) for r in t.to_pylist()}
    assert got == want


def test_a_block_without_all_its_answers_is_an_error(texts, monkeypatch):
    from deliverix.llm import cold_scores
    answers, _ = asked(texts, monkeypatch, 8, 10 ** 6)
    with pytest.raises(RuntimeError, match="same order"):
        cold_scores._texts(answers.slice(0, answers.num_rows - 1))


def test_a_lookup_is_a_few_bytes(texts, monkeypatch):
    from deliverix.llm import cold_scores
    assert cold_scores.parts_of(0, 0) == 1 and cold_scores.parts_of(10 ** 6, 10 ** 6) == 8 and cold_scores.parts_of(0, 10 ** 9) == 256
    for kind in (cold_scores.TOKEN, cold_scores.TOKEN + 1, cold_scores.WORD):
        assert sum(np.dtype(t).itemsize for t in cold_scores.COLUMNS[kind]) <= 34
