"""The pipeline's stages and run() on a small table with null and repeated ids, against plain Python.

The classifier's model has no plain version: its stage is held against the scores of the rows.
"""

import re
import zlib
from collections import Counter

import numpy as np
from test_operators import id_key, kept_by_class, words

import corpus_pipeline
from deliverix.llm import classifier, mixing
from deliverix.llm.shared import fold_of

LABELS, BENCH = [(1, 1), (8, 0), (None, 1), (77, 1), (9, None)], [(1, "Short ONE"), (2, "no such words in any text at all, really none of them"), (3, None)]


def texts(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_stages_and_run(spark, make_docs, odd_rows, tmp_path):
    from pyspark.sql import functions as F
    near = lambda n, k: " ".join(f"z{n}" if j == k else f"w{n}x{j}" for j in range(140))
    rows = odd_rows + [(None, near(1, 5), "a"), (None, near(2, 5), "a"), (70, near(1, 60), "a"), (71, "it was a short one", "a"), (71, near(5, 5), "b")]
    sf = str(tmp_path)
    make_docs(rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = {name: f for name, f in corpus_pipeline.STAGES}

    good = stage["quality classifier"](spark, docs, sf)
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    model = classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held))
    n = Counter(r.doc_id for r in classifier.score(docs, model).where(F.col("score") >= classifier.CUT).collect())
    assert Counter(r.doc_id for r in good.collect()) == n

    first = texts(stage["n-gram Jaccard join"](spark, docs, sf))
    least, label, sets = kept_by_class(rows)
    at = {(i, t): k for (i, t, _), k in zip(rows, label)}
    worded = [r for r in first.elements() if words(r[1])]
    assert sorted(at[r[:2]] for r in worded) == sorted({k for k, s in zip(label, sets) if s})  # of each class one row
    assert all(r[0] == least[at[r[:2]]] for r in worded)
    assert +first - Counter(worded) == Counter(r for r in rows if not words(r[1]))

    clean = texts(stage["benchmark decontamination"](spark, docs, sf))
    assert clean == Counter(r for r in rows if not re.search(r"\bshort\W+one\b", (r[1] or "").lower()))

    mixed = stage["mixing sources to target weights"](spark, docs, sf)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.epochs + r.picked
    assert Counter(r.doc_id for r in mixed.collect()) == +taken

    from tokenizers import Tokenizer

    from deliverix.llm import token_output
    plain = Tokenizer.from_file(token_output.tokenizer_path())

    def tokens(table):
        ids = [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, token_output.END_ID], "<u4")) for i, t, _ in table]
        return Counter((i, len(x), zlib.crc32(x)) for i, x in ids)

    def placed(out):
        total = 0
        for r in sorted(out, key=lambda r: r.start):
            assert r.start == total
            total += r.n_tokens
        assert [id_key(r.doc_id) for r in sorted(out, key=lambda r: r.start)] == sorted(id_key(r.doc_id) for r in out)
        return Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out)

    assert placed(stage["token-ID / binary output"](spark, docs, sf).collect()) == tokens(rows)

    through = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        through = f(spark, through, sf)
    assert placed(corpus_pipeline.run(spark, sf).collect()) == tokens(texts(through).elements())
