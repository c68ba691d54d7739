import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with every column null somewhere, ties, repeated rows, and columns whose names the operators use inside."""
    def make(rows):
        df = spark.createDataFrame([(*r, "en", "s", 1)[:3] + ((r[2] if len(r) > 2 else "s"), None) if len(r) <= 3 else r for r in rows], DOCS)
        from pyspark.sql import functions as F
        for name in ("doc", "th", "key", "id", "size", "label", "node", "bin", "hit", "m", "h", "tag", "place"):
            df = df.withColumn(name, F.lit("x"))
        return df
    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and sources, empty and blank texts, one very long text, copies, ties and repeated rows."""
    import random
    rng = random.Random(3)
    long_ = " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(30_000))
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    passage = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60))
    return [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), None), (4, None, "b"), (5, "", "b"), (6, " \t\n ", "b"),
            (None, "one two three", None), (None, None, None), (7, long_, "c"), (8, "x y " + passage + " z", "c"), (9, passage + " tail\nline\nline", "c"),
            (10, "same same same same same same same same same same same same same same same same same same same same same same", "c"),
            (11, "ÄÖ é b \U0001F600 End.", "c"), (12, "short one", "a"), (12, "another text of that id", "a")]
