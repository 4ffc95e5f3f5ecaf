import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=3):
    """Small documents with every awkward case: nulls, empties, copies, near copies, a long text, repeated rows."""
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "the", "of", "und", "der", "les", "que", "über", "naïve", "año", "run", "x1"]
    words = lambda n: " ".join(rng.choice(vocab) + (rng.choice(["", "", ",", "."])) for _ in range(n))
    base = " ".join(f"w{i}" for i in range(120))
    out = [(i, words(rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0) for i in range(40)]
    out += [(100 + i, base.replace(f"w{3 * i + 5} ", "zz "), "en", "a", 0) for i in range(12)]
    out += [(200, base, "en", "a", 0), (201, base.upper(), "en", "b", 0), (202, base, "de", "c", 0), (202, base, "de", "c", 0)]
    out += [(300, None, "en", "a", 0), (301, "", "en", "b", 0), (302, " \n\t ", None, "c", 0), (303, "!!! 123 ###", "en", "c", 0), (None, "no id here at all", "en", "a", 0)]
    out += [(400, words(6000) + " " + "y" * 20000, "de", "b", 0), (401, "中文 text 🙂 \x1f odd space <|endoftext|> end", "en", "a", 0), (402, "one two three", "en", "a", 0), (403, "ONE two three", "en", "a", 0)]
    return out


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("node", "p", "size", "h", "rid", "t", "kept", "score", "label", "_id", "_key", "rank", "blocks", "position", "part", "_row", "_hash", "_salt", "_h", "a.b")
    return docs.withColumns({n: F.lit("x") for n in names})
