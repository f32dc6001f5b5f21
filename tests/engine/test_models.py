"""Models inside tasks: batches, checks of what they return, and vectors learned from a corpus."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import models as m
from quarrylight.operators.documents import chunks as chunked
from quarrylight.plans.engine import Engine
from quarrylight.plans.queries import QUERIES, SQL
from quarrylight.plans.store import Store
from tests.engine.test_documents_and_graph import SHA, TREE, nodes_of

DATA = "/root/testdata/sf0.001"


def test_groups_hold_like_lengths_and_every_place():
    lengths = [random.Random(3).randrange(0, 400) for _ in range(300)] + [5000, 0]
    groups = list(m.length_groups(lengths, 1000))
    assert sorted(i for g in groups for i in g) == list(range(len(lengths)))
    assert all(len(g) == 1 or max(lengths[i] for i in g) * len(g) <= 1000 for g in groups)
    assert list(m.length_groups([])) == []


def test_encoder_keeps_order_and_nulls(spark):
    texts = [None, "", "a", "x" * 5000, *("y" * (i % 37) for i in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    encode = m.encoder(lambda: lambda ts: np.array([[len(t), 1.0] for t in ts]), 2)
    got = dict(df.select("id", encode(F.col("text"))).collect())
    assert got == {i: None if t is None else [float(len(t)), 1.0] for i, t in enumerate(texts)}


@pytest.mark.parametrize(("out", "message"), [
    (lambda ts: np.zeros((len(ts) + 1, 2)), "rows for"), (lambda ts: np.zeros((len(ts), 3)), "shape"),
    (lambda ts: np.full((len(ts), 2), np.nan), "not finite"), (lambda ts: 1.0, "no rows"),
])
def test_wrong_output_is_refused(spark, out, message):
    with pytest.raises(ValueError, match=message):
        m._grouped(out, (np.array(["a", "bb"]),), (2,))
    df = spark.createDataFrame([("a",), ("bb",)], "text string")
    with pytest.raises(Exception, match=message):
        df.select(m.encoder(lambda: out, 2)(F.col("text"))).collect()


def test_word_vectors_against_loops(spark, monkeypatch):
    monkeypatch.setattr(m, "HELD_WORDS", 3)
    r = random.Random(5)
    texts = [None, "", *(" ".join(f"w{r.randrange(30)}" for _ in range(12)) for _ in range(40))]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, word string")
    want = {}
    for words in (set((t or "").split()) for t in texts):
        context = [0] * 8
        for w in words:
            place, sign = m.index_place(w, 8)
            context[place] += sign
        for w in words:
            n, v = want.get(w, (0, [0] * 8))
            want[w] = (n + 1, [a + b for a, b in zip(v, context, strict=True)])
    got = {x["word"]: (x["df"], x["vector"]) for x in m.word_vectors(df, dimension=8).collect()}
    assert got == want
    assert m.word_vectors(df.limit(0)).collect() == []


def test_trained_model_knows_which_words_meet(spark):
    r = random.Random(7)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(4)]
    rows = [(k, " ".join(r.choice(topics[k]) for _ in range(15))) for k in range(4) for _ in range(60)]
    df = spark.createDataFrame(rows, "topic long, text string")
    model = m.train(df)
    encoded = df.select("topic", m.trained_encoder(model)(F.col("text")).alias("v")).collect()
    v, topic = np.array([x["v"] for x in encoded]), np.array([x["topic"] for x in encoded])
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
    likeness = v @ v.T
    np.fill_diagonal(likeness, -2)
    assert (topic[likeness.argmax(axis=1)] == topic).mean() > 0.95
    score = m.trained_scorer(model)
    # No word of the query stands in these texts, yet those of its topic come first.
    asked = df.where("not text rlike 't2w1 |t2w2 |t2w3 '").select("topic", score(F.lit("t2w1 t2w2 t2w3"), F.col("text")).alias("s")).orderBy(F.desc("s")).limit(10).collect()
    assert {x["topic"] for x in asked} == {2}
    assert df.limit(1).select(score(F.lit(None).cast("string"), F.col("text"))).first()[0] is None


def test_engine_answers_with_a_trained_model(spark, tmp_path):
    nodes = nodes_of(spark, TREE)
    model = m.train(chunked(nodes), vocabulary=1000)
    store = Store(spark, str(tmp_path / "store"), 64)
    engine = Engine(spark, store, m.trained_encoder(model), m.trained_scorer(model))
    assert engine.index("o/r", nodes, 1000, SHA).status == "ready"
    found = engine.find_chunks(spark.createDataFrame([(1, "setup of deep file")], "query_id long, query string"), 1001)
    assert found.status == "ready" and not found.envelope["degraded"]
    assert found.rows.where("rerank_score is not null").count() == found.rows.count() > 0


def test_too_large_a_vocabulary_is_refused(spark):
    with pytest.raises(ValueError, match="bytes"):
        m.train(spark.createDataFrame([("a",)], "text string"), vocabulary=10**7)


def test_word_vectors_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(SQL["word_vectors"]).fetchall()
    got = QUERIES["word_vectors"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(want) and got


def test_word_vectors_in_bounded_batches(spark, monkeypatch):
    """Many long texts in one partition reach Python in batches of bounded bytes, and are handed on in the middle of a batch with equal sums."""
    texts = spark.range(3000, numPartitions=1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), (i + F.col("id") % 7).cast("string"))), " ").alias("text"))
    few = texts.limit(20)
    want = sorted(map(str, m.word_vectors(few).collect()))
    sizes = texts.select(F.split("text", " ").alias("words")).mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 12 << 20
    monkeypatch.setattr(m, "HELD_WORDS", 10)
    assert sorted(map(str, m.word_vectors(few).collect())) == want
