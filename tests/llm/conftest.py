import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("kept", T.StringType()),  # clashes with names that operators make
        T.StructField("key", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("n_words", T.StringType()),
    ]
)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def odd_rows(seed=5):
    """Null and empty values, very long texts, ties, near copies, repeated rows, special strings."""
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\n", "one", "two words", "  lead\tand\r\ntrail \x0b\x0c", "<|endoftext|> a  <|endoftext|>b", "ünï cödé 日本   x y 🤷🏽", "don't we'll I'm 12,345.67 #*$%&|<>", "x" * 5000, " ".join(["same"] * 700)]
    long = sentence(rng, 20000)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    texts += [long, long, base, base, base.upper().lower()]
    for _ in range(30):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    texts += [sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 30) for _ in range(6)]
    texts += [sentence(rng, rng.randint(1, 80)) + rng.choice([".", "\n", "", " +1 (123) 555-1234", " a.b@c.example.com", " 10.20.30.40"]) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "c", "k", "i", "w") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def with_repeats(spark):
    """Repeated rows and a null id."""
    rows = odd_rows()[:25]
    return spark.createDataFrame(rows + rows[3:12] + [(None, "a text without an id", "en", "s0", 1, "c", "k", "i", "w")], SCHEMA)
