import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use themselves
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("row", T.StringType()), T.StructField("_key", T.StringType()), T.StructField("tokens", T.LongType()),
])


def corpus(seed=5):
    """Small corpus with copies, near copies, shared passages, runs, nulls, empties, ties and one long text."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(700)] + ["été", "naïve", "日本", "The", "END."]
    passage = rnd.choices(vocabulary, k=70)
    texts = []
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 160))
        if i % 5 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[7].upper(), texts[10] + " tail", "  " + texts[11].replace(" ", "\n\t") + " "]
    for _ in range(12):
        words = texts[20].split()
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", "   \n ", "one", "one two three", "one two three", "be " * 130, "x " + "be " * 77, "a b " * 90, "b a " * 60, "# $ %%% | <b>&", "\u00a0 nbsp\u00a0joined", "line one\nline one\n\nline two\nline one"]
    texts.append(" ".join(rnd.choices(vocabulary, k=12000)))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src2", "src7", "odd", None]), len(t or ""), None, "k", "r", "u", 1) for i, t in zip(ids, texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows and a repeated id."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 7
    row = lambda i, x: (i, x, None, None, None, None, None, None, None, None)
    return spark.createDataFrame([row(None, t), row(4, t), row(4, t), row(9, t + "more"), row(9, "another text"), row(None, None), row(None, "lonely words here")], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    from pyspark.sql import functions as F  # noqa: F401

    data = [(r[0], 0 if (r[1] or "").startswith("b") else 1, 0) for r in rows if r[0] % 3] + [(None, 1, 1), (1, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
