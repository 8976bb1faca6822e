import random

import pytest
from pyspark.sql import types as T

#: Column names of documents and some that operators use themselves.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("cell", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("shard", T.StringType())])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def nasty_rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(25)]
    passage = prose(rng, 70)
    texts = [*base, None, "", "  \n\t ", "one", "one", "ONE two", base[3], base[3], base[3].upper(), passage, f"{base[4]} {passage}", f"{passage}\n{base[5]}\n{passage}", prose(rng, 3000), " ".join(["same"] * 300), " ".join(["same"] * 310), "é ü ñ " * 40, "x" * 5000]
    for k in range(12):  # near copies
        words = base[6].split()
        words[k % len(words)] = f"edit{k}"
        texts.append(" ".join(words))
    rows = [(i * 3 % 101, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), len(t or ""), "c", "n", "s") for i, t in enumerate(texts)]
    return [*rows, rows[0], (rows[1][0], "other text of the same id", "en", "s", 25, None, None, None), (None, base[7], "en", "s", 9, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return nasty_rows()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def big():
    return 1 << 62  # stands for a null id, after all others
