"""Operator 10's contexts of tokens against a plain suffix tree; spelling and base stay as they are without them."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from deliverix.llm import lm_scoring, token_tree

DEPTH, PRIOR = token_tree.DEPTH, 4.0


def tokens(text):
    return ["<s>", *(text or "").split(), "</s>"]


def brute_gains(train, texts, root, min_count, min_pair, min_divergence):
    """log10 of what the retained contexts make of each text against the root alone."""
    words = Counter(w for t in train for w in tokens(t)[1:])
    symbols = {w for w, n in words.items() if n >= min_count} | {"</s>"}
    n, total = defaultdict(Counter), Counter()
    for t in train:
        x = tokens(t)
        for k in range(1, len(x)):
            for d in range(1, min(DEPTH, k) + 1):
                c = tuple(x[k - d:k])
                total[c] += 1
                n[c][x[k]] += 1
    n = {c: {x: m for x, m in follow.items() if x in symbols and m >= min_pair} for c, follow in n.items() if total[c] >= min_count}

    def diverges(c):
        q = {x: n[c[1:]][x] / total[c[1:]] if len(c) > 1 else root[x] for x in n[c]}
        rest = total[c] - sum(n[c].values())
        out = sum(m * math.log(m / total[c] / q[x]) for x, m in n[c].items())
        return out + (rest * math.log(rest / total[c] / max(1 - sum(q.values()), 1e-12)) if rest else 0) >= min_divergence

    kept = set()
    for c in sorted(n, key=len, reverse=True):
        if n[c] and (c in kept or diverges(c)):
            kept.update(c[i:] for i in range(len(c)))

    def p(c, x):
        if not c:
            return root[x]
        rest = total[c] - sum(n[c].values()) + PRIOR
        return (n[c].get(x, 0) + rest * p(c[1:], x)) / (total[c] + PRIOR)

    out = []
    for t in texts:
        x, gain = tokens(t), 0.0
        for k in range(1, len(x)):
            c = next((tuple(x[k - d:k]) for d in range(min(DEPTH, k), 0, -1) if tuple(x[k - d:k]) in kept), ())
            if c:
                gain += math.log10(p(c, x[k]) / root[x[k]])
        out.append(gain)
    return out, kept


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(30)]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}
    pairs = {(a, b): rng.choice(vocabulary) for a in vocabulary[:6] for b in vocabulary}
    triples = {(a, b, c): rng.choice(vocabulary[:4]) for a in vocabulary[:4] for b in vocabulary[:4] for c in vocabulary[:4]}
    out = []
    for _ in range(300):
        x = [rng.choice(vocabulary[:5])]
        for _ in range(rng.randint(0, 40)):
            r = rng.random()
            x.append(triples[tuple(x[-3:])] if tuple(x[-3:]) in triples and r < 0.8 else pairs.get(tuple(x[-2:]), "w0") if r < 0.4 and len(x) > 1 else rng.choice(follow.get(x[-1], vocabulary)) if r < 0.8
                     else f"rare{rng.randint(0, 400)}" if r > 0.97 else rng.choice(vocabulary))
        out.append(" ".join(x))
    return [*out, "", None, "w1", "unseen words only", out[0], out[0]]


def test_contexts_against_brute_force(make_docs, corpus):
    train = F.col("doc_id") % 3 != 0
    kinds = sorted({w for t in corpus for w in tokens(t)[1:-1]})
    docs = make_docs([(k, t, "a") for k, t in enumerate(corpus)])
    used = [t for k, t in enumerate(corpus) if k % 3]
    # texts of one word that are not learnt from tell the root, word by word
    single = make_docs([(k, t, "a") for k, t in enumerate(corpus)] + [(3 * (1000 + k), w, "a") for k, w in enumerate(kinds)])
    for min_count, min_divergence in ((8, 8.0), (20, 2.0), (8, 30.0)):
        base = {r.doc_id: r.score for r in lm_scoring.score(single, train, min_divergence=min_divergence, min_count=10 ** 9).collect()}
        end = 10 ** base[corpus.index("")]
        root = {w: 10 ** base[3 * (1000 + k)] / end for k, w in enumerate(kinds)} | {"</s>": end}
        want, kept = brute_gains(used, corpus, root, min_count, 4, min_divergence)
        assert {len(c) for c in kept} >= ({1, 2} if min_divergence < 10 else {1})
        for hot in (10 ** 6, 40, 0):  # all contexts broadcast, some, none
            got = {r.doc_id: r.score for r in lm_scoring.score(docs, train, min_divergence=min_divergence, min_count=min_count, min_pair=4, hot_contexts=hot).collect()}
            for k in range(len(corpus)):
                assert got[k] - base[k] == pytest.approx(want[k], abs=1e-6), (k, hot)
    assert sum(want[k] for k in range(len(corpus)) if k % 3 == 0) > 0  # held-out texts gain


def test_distributions_add_up_to_one(spark, corpus):
    """Over all symbols, what a context tells is one: entries and, for the rest, the suffix's share."""
    rows = [(t,) for t in corpus if t]
    words = Counter(w for (t,) in rows for w in t.split())
    import numpy as np
    import pyarrow as pa

    from deliverix.llm.shared import Words, signed
    keys = {w: int(signed(Words(pa.array([w])).hash)[0]) for w in words}
    total = sum(words.values()) + len(rows)
    table = spark.createDataFrame([(keys[w], c, math.log10(c / total)) for w, c in words.items()], "key long, c long, log_p double")
    tree = token_tree.grow(spark.createDataFrame(rows, "text string"), table, len(rows), len(rows) / total, 4.0, 8, 4)
    entries = {}
    for r in tree.entries.collect():
        entries.setdefault(r.ctx, {})[r.key] = r.gain
    begin, end = signed(np.array([token_tree.BEGIN, token_tree.END])).tolist()
    roots = {keys[w]: c / total for w, c in words.items()} | {end: len(rows) / total}
    back = {r.ctx: r.back for r in tree.contexts.collect()}
    level1 = [c for c in back if c in roots or c == begin]
    assert len(level1) > 20
    u = lambda x: np.array([x], np.int64).view(np.uint64)
    for c in level1:
        run = {x: int(signed(token_tree.run_key(u(c), u(x)))[0]) for x in roots}
        p = sum(q * 10 ** entries[c].get(run[x], back[c]) for x, q in roots.items())
        assert p == pytest.approx(1.0, abs=1e-9)


def test_index():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(-2 ** 63, 2 ** 63, n))
        rng.shuffle(keys)
        if n > 10:
            keys[:3] = [-1, 0, 1]
            keys = np.unique(keys)[::-1].copy()
        index = token_tree.Index(keys)
        place, has = index.find(keys.view(np.uint64))
        assert has.all() and (place == np.arange(len(keys))).all()
        others = np.setdiff1d(rng.integers(-2 ** 63, 2 ** 63, 5000), keys)
        assert not index.find(others.view(np.uint64))[1].any()


def test_bitmaps(spark):
    import numpy as np
    rng = random.Random(2)
    keys = [rng.randint(-2 ** 63, 2 ** 63 - 1) for _ in range(5000)]
    bits = token_tree.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert token_tree.in_bitmap(bits, np.array(keys, np.int64).view(np.uint64)).all()
    others = np.array([rng.randint(-2 ** 63, 2 ** 63 - 1) for _ in range(5000)], np.int64).view(np.uint64)
    assert token_tree.in_bitmap(bits, others).mean() < 0.01
    assert not token_tree.bitmap(spark.createDataFrame([], "key long")).any()
