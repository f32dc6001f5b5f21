"""Blocked vector search and block-max lexical search against exhaustive ones; failures of single repositories."""

import glob
import math
import os
import random
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import lexical as lx
from quarrylight.operators import ranking as rk
from quarrylight.operators import vector_search
from quarrylight.operators.vector_search import best_rows, nearest
from quarrylight.plans.engine import Engine
from quarrylight.plans.store import Store
from tests.engine.test_documents_and_graph import SHA, TREE, nodes_of

CHUNKS = "repo string, id long, embedding array<float>"
QUERIES = "query_id long, vector array<float>"


def brute(chunks, queries, k, grouped):
    def cosine(a, b):
        if len(a) != len(b):
            return 0.0
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        n = math.sqrt(a @ a) * math.sqrt(b @ b)
        return round(float(a @ b) / n, 12) if n else 0.0

    out = []
    for q, v in queries:
        groups = {}
        for repo, i, x in chunks:
            if x is not None:
                groups.setdefault(repo if grouped else 0, []).append((-cosine(x, v), repo is not None, repo or "", i))
        for rows in groups.values():
            out += [(q, repo if named else None, i, n) for n, (_, named, repo, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("gathered", [1, 40, 1 << 14])
def test_nearest_is_exact(spark, grouped, gathered):
    r = random.Random(5)
    vectors = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(30)]
    chunks = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), i, r.choice(vectors)) for i in range(400)]
    chunks += [("a", 1000, None), ("b", 1001, [0.0] * 4), ("a", 1002, [1.0]), ("only", 1003, [1.0] * 4)]
    queries = [(i, r.choice(vectors)) for i in range(7)] + [(99, [0.0] * 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        found = nearest(spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame(queries, QUERIES), ["repo", "id"], 6, group="repo" if grouped else None, gathered=gathered)
        rows = [(x["query_id"], x["repo"], x["id"], x["rank"]) for x in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(rows, key=str) == brute(chunks, queries, 6, grouped)


def test_nearest_without_rows_or_queries(spark):
    chunks, queries = spark.createDataFrame([("a", 1, [1.0, 2.0])], CHUNKS), spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    assert nearest(chunks.where("false"), queries, ["repo", "id"], 3).collect() == []
    assert nearest(chunks, queries.where("false"), ["repo", "id"], 3).collect() == []
    with pytest.raises(ValueError, match="dimensions"):
        nearest(chunks, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], QUERIES), ["repo", "id"], 3)


def test_the_plan_has_no_row_a_pair(spark):
    chunks, queries = spark.createDataFrame([("a", 1, [1.0, 2.0])], CHUNKS), spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    plan = nearest(chunks, queries, ["repo", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_rows_of_many_queries():
    r = np.random.default_rng(1)
    scores, groups = r.integers(0, 5, (200, 9)).astype(float), r.integers(0, 4, 200)
    q, rows = best_rows(scores, groups, np.arange(200), 5)
    for query in range(9):
        for g in range(4):
            own = [i for i in range(200) if groups[i] == g]
            want = sorted(own, key=lambda i: (-scores[i, query], i))[:5]
            assert sorted(x for x in rows[q == query] if groups[x] == g) == sorted(want)


def test_what_a_task_holds_does_not_grow_with_rows_times_queries():
    """All rows are among the best of some query, over many groups: a row's scores for all queries are not held."""
    r = np.random.default_rng(3)
    wanted, x, k = r.normal(size=(600, 8)), r.normal(size=(6000, 8)).astype(np.float32), 20
    wanted /= np.sqrt((wanted * wanted).sum(1, keepdims=True))
    table = pa.table({"repo": [None if i % 15 == 0 else f"r{i % 15}" for i in range(6000)], "id": range(6000), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 8).cast(pa.list_(pa.float32()))})
    best = vector_search._Best(wanted, ["repo", "id"], "repo", k)
    for at in range(0, 6000, 1700):
        best.add(table.slice(at, 1700).combine_chunks(), "embedding")
    held = sum(a.nbytes for arrays in best.held.values() for a in arrays) + best.groups.nbytes
    assert best.keys.num_rows > 5000 and held <= 16 * 600 * 15 * k + 4 * 6000 < 6000 * 600
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    scores = np.round(unit @ wanted.T, 12)
    want = {(q, g + 15 * int(i)) for q in range(600) for g in range(15) for i in np.argsort(-scores[g::15, q], kind="stable")[:k]}
    out = [(q, i) for batch in best.out() for q, i in zip(batch.column("q").to_pylist(), batch.column("id").to_pylist(), strict=True)]
    assert len(out) == len(want) and set(out) == want


@pytest.fixture
def texts(spark):
    """A common word in every chunk, rare words in few; short and long chunks; a null text, an empty one, a nameless repository."""
    r = random.Random(8)
    rows = []
    for i in range(900):
        words = ["common"] * r.randrange(1, 3) + [f"w{int(r.paretovariate(0.6)) % 500}" for _ in range(r.choice([4, 9, 60, 300]))]
        rows.append((["a", "b", None, "hot", "hot"][i % 5], i, " ".join(words)))
    return spark.createDataFrame([*rows, ("a", 5000, None), ("b", 5001, ""), ("lone", 5002, "Common, café!")], "repo string, id long, text string")


@pytest.mark.parametrize("per_group", [True, False])
def test_block_max_is_exact_and_skips_segments(spark, texts, tmp_path, monkeypatch, per_group):
    monkeypatch.setattr(lx, "SEGMENT", 8)
    queries = spark.createDataFrame([(1, "common w1 w3"), (2, "w7 w7 w11 common"), (3, "nothing"), (4, "??"), (5, "cafe w2")], "query_id long, query string")
    key = ["repo", "id"]
    lx.write_index(texts, key, str(tmp_path / "index"))
    index = lx.read_index(spark, str(tmp_path / "index"))
    asking = lx.question(index, queries)
    found = lx.topk(asking, key, 4, per_group=per_group)
    scores = rk.bm25_scores(rk.postings(texts, key), rk.corpus_stats(texts), queries, key)
    groups = {}
    for x in scores.collect():
        groups.setdefault((x["query_id"], x["repo"] if per_group else 0), []).append((-round(x["score"], 9), x["repo"] is not None, x["repo"] or "", x["id"]))
    want = sorted(((q, name if named else None, i, n) for (q, _), rows in groups.items() for n, (_, named, name, i) in enumerate(sorted(rows)[:4], 1)), key=str)
    assert sorted(((x["query_id"], x["repo"], x["id"], x["rank"]) for x in found.rows.collect()), key=str) == want
    counts = found.segments.agg(F.sum("segments"), F.sum("scored")).first()
    assert counts[1] < counts[0]
    # The common term has a block in each segment, none of them larger than a segment.
    blocks = index[0].where("term = 'common'")
    assert blocks.count() > 50 and blocks.agg(F.max("n")).first()[0] < 40 and blocks.agg(F.sum("n")).first()[0] == 901
    hits = {(x["query_id"], x["repo"]): x["bm25_total"] for x in lx.totals(asking, key).collect()}
    assert hits == {k: v for k, v in {(x["query_id"], x["repo"]): x["n"] for x in scores.groupBy("query_id", "repo").agg(F.count(F.lit(1)).alias("n")).collect()}.items()}


def test_an_index_of_nothing(spark, texts, tmp_path):
    lx.write_index(texts.where("false"), ["repo", "id"], str(tmp_path / "index"))
    index = lx.read_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "common")], "query_id long, query string")
    asking = lx.question(index, queries)
    assert lx.topk(asking, ["repo", "id"], 4).rows.collect() == [] and lx.totals(asking, ["repo", "id"]).collect() == []



@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    """Two repositories, the second without a word of the first's."""
    engine = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("two") / "store"), 64))
    engine.index("o/r", nodes_of(spark, TREE), 1000, SHA)
    chunks = engine.store.chunks().withColumn("text", F.lit("wholly unlike prose"))
    engine.store.rebuild("o/s", chunks, engine.store.edges().where("false"), 1000, SHA)
    return engine


def modes(answer):
    return {(r["query_id"], r["repo"]): (r["mode"], r["reason"], r["bm25_count"] > 0) for r in answer.envelope["repos"].collect()}


def test_repositories_without_a_match_or_with_broken_postings(spark, two):
    """A repository that was asked is hybrid, matched or not; one whose postings can't be used is answered by vectors, the others stay."""
    queries = spark.createDataFrame([(0, "deep"), (1, "???")], "query_id int, query string")
    answer = two.find_chunks(queries, 2000)
    wordless = {(1, r): ("vector_only", "empty_query_tokens", False) for r in ("o/r", "o/s")}
    assert modes(answer) == {(0, "o/r"): ("hybrid", None, True), (0, "o/s"): ("hybrid", None, False)} | wordless
    info = {r["query_id"]: r for r in answer.envelope["queries"].collect()}
    assert [(info[i]["mode"], info[i]["reason"], info[i]["rrf_k"], info[i]["fused_count"]) for i in (0, 1)] == [("hybrid", None, 60, 6), ("vector_only", "empty_query_tokens", 60, 6)]
    for path in glob.glob(os.path.join(two.store.folder, "postings", "repo=o%2Fs", "**", "*.parquet"), recursive=True):
        with open(path, "r+b") as file:
            file.truncate(20)
        os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    answer = two.find_chunks(queries, 2000)
    assert modes(answer) == {(0, "o/r"): ("hybrid", None, True), (0, "o/s"): ("vector_only", "damaged_postings", False)} | wordless
    assert {r["query_id"]: (r["mode"], r["reason"]) for r in answer.envelope["queries"].collect()} == {0: ("partial", None), 1: ("vector_only", "empty_query_tokens")}
    assert {r["repo"] for r in answer.rows.collect()} == {"o/r", "o/s"}
    shutil.rmtree(os.path.join(two.store.folder, "lengths", "repo=o%2Fr"))
    assert {r["repo"]: r["reason"] for r in two.store.lexical_state().collect()} == {"o/r": "no_postings", "o/s": "damaged_postings"}


def test_no_posting_becomes_a_row(spark, texts, tmp_path):
    """Neither the index nor a question makes a row of a posting (and query): both would be shuffled."""
    lx.write_index(texts, ["repo", "id"], str(tmp_path / "index"))
    index = lx.read_index(spark, str(tmp_path / "index"))
    asking = lx.question(index, spark.createDataFrame([(1, "common w1 w3"), (2, "common w7")], "query_id long, query string"))
    indexed = spark.read.parquet(str(tmp_path / "index" / "forward"))
    for made in (lx.blocks(indexed, ["repo"], ["id"]), lx.topk(asking, ["repo", "id"], 4).rows, lx.totals(asking, ["repo", "id"])):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_segment_in_many_batches(spark, texts, tmp_path):
    queries = spark.createDataFrame([(1, "common w1 w3"), (2, "w7 w7 w11 common")], "query_id long, query string")
    key, found = ["repo", "id"], []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        lx.write_index(texts, key, str(tmp_path / n))
        asking = lx.question(lx.read_index(spark, str(tmp_path / n)), queries)
        found.append([sorted(map(str, rows.collect())) for rows in (lx.topk(asking, key, 4).rows.drop("score"), lx.totals(asking, key))])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and found[0][0]


def test_texts_reach_python_in_bounded_batches(spark):
    """The tokens of many long texts of one partition are not one batch."""
    texts = spark.range(3000, numPartitions=1).select(F.lit("a").alias("repo"), "id", F.repeat(F.lit("word "), 2000).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    lx.forward(texts, ["repo", "id"])
    sizes = texts.select(F.split("text", " ").alias("words")).mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 20 << 20


def test_a_segment_of_long_texts_is_bounded(spark, tmp_path):
    """Segments of long chunks hold fewer of them; the blocks still have all postings."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")).cast("string"))), " ")
    texts = spark.range(1000, numPartitions=4).select(F.lit("a").alias("repo"), "id", words.alias("text"))
    lx.write_index(texts, ["repo", "id"], str(tmp_path / "index"))
    sizes = [r["n"] for r in lx.read_index(spark, str(tmp_path / "index"))[0].groupBy("segment").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 1_500_000 and max(sizes) < 1.5 * lx.POSTINGS
