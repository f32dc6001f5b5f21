import random

import pytest

from quarrylight.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source) rows."""
    prepare(spark)

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], SCHEMA)

    return make


@pytest.fixture
def prose():
    """Random words, the same for a seed."""

    def make(seed, n=60, words=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(words)}" for _ in range(n))

    return make


@pytest.fixture
def odd(prose):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "\n".join(prose(i, 40) for i in range(2000)) + " " + "x" * 200_000
    same = "The same line stands here.\nAnd another same line."
    return [
        (None, None, None), (None, "a null id with some text", "s"), (1, None, "s"), (2, "", "s"), (3, "   \n\t ", None), (4, long, "t"),
        (5, same, "s"), (5, same, "s"), (6, same, "t"), (6, "an id again, another text", "t"), (7, "é" * 30 + "\U0001f600 end", "u"), (8, "one two", None),
    ]


#: Names that operators use inside or return.
CLASH = ["id", "h1", "h2", "row", "__row", "key", "domain", "host", "path", "rule", "verdict", "keep_id", "group_size", "kept", "size", "source_size", "part", "epoch", "words", "ids", "decoded", "score", "predicted", "fingerprint", "class_id", "class_size", "n_lines", "N_DROPPED", "text_sha256", "digest", "salt", "root", "payload", "uri", "drops", "first"]


@pytest.fixture
def clashing():
    from pyspark.sql import functions as F

    def make(df):
        return df.withColumns({c: F.lit("mine") for c in CLASH if c.lower() not in {x.lower() for x in df.columns}})

    return make
