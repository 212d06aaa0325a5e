import random

import pytest

CLASH = "row rk doc n_words n_removed kept removed spans items size source_size target copies taken hash node class_id score threshold toxic place slot shard tie bucket mentions gaps n_entities kinds key main pivot component head".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text[, lang, source]), with extra columns whose names clash with the operators' own."""

    def make(rows, clash=True):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
        return df.repartition(3) if rows else df

    return make


@pytest.fixture
def words():
    rng = random.Random(11)
    return lambda n, vocabulary=500: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Rows that every operator on documents must bear: nulls, empty and blank texts, repeats, ties, a null id, a very long text.
def odd_rows():
    long = " ".join(f"x{k % 997} y{k}" for k in range(30_000))
    return [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "de", "b"), (4, "one", "de", "b"), (4, "two words", "de", "b"), (None, "no id here " * 30, "en", None), (5, long, "en", "a"), (6, "é ü     😀 " * 20, "fr", "c")]
