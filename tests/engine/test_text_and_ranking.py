import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.operators import ranking as rk


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens_and_query_escape(spark):
    assert one(spark, tx.query_tokens(F.col("q")), q="snake_case fts5(text) the the ???") == ["snakecase", "fts5text", "the", "the"]
    assert one(spark, tx.query_tokens(F.col("q"), True), q="snake_case") == ["snake", "case"]
    assert one(spark, tx.match_expression(F.col("q")), q="Café a-b ---") == '"Café" OR "ab"'
    assert one(spark, tx.match_expression(F.col("q")), q=" ?! ") == ""
    assert one(spark, tx.index_tokens(F.col("q")), q="Café au_lait, naïve!") == ["cafe", "au", "lait", "naive"]
    assert one(spark, tx.estimate_tokens(F.col("q")), q="ab\U0001f600c") == 2


def test_links_and_ids(spark):
    sha = "a" * 40
    url = f"https://github.com/o/r/blob/{sha}/src/a.py#L3-L9"
    assert tuple(one(spark, tx.blob_link(F.col("u")), u=url)) == ("o/r", sha, "src/a.py", "L3-L9")
    assert one(spark, tx.blob_link(F.col("u")), u="https://github.com/o/r") is None
    text = f"see [one](#intro) and [two]({tx.WIKI_BASE}o/other#deep) and [x](https://elsewhere.org/y) [f]({url})"
    assert [tuple(x) for x in one(spark, tx.markdown_links(F.col("t")), t=text)] == [("one", "#intro"), ("two", f"{tx.WIKI_BASE}o/other#deep")]
    assert [tuple(x) for x in one(spark, tx.prose_blob_links(F.col("t")), t=text)] == [("f", "o/r", sha, "src/a.py", "L3-L9")]
    assert one(spark, tx.slug_of(F.col("i")), i="o/r#sec::node") == "sec"
    assert one(spark, tx.strip_repo(F.col("i"), F.lit("o/r")), i="o/r#sec") == "sec"


@pytest.mark.parametrize("url,want", [
    ("git+https://github.com/a/b.git", "a/b"), ("git@github.com:a/b.git", "a/b"), ("a/b", "a/b"), ("https://gitlab.com/a/b", None),
    ("https://github.com/a", None), ("http://www.github.com/a/b", None), ("https://github.com/a/b/tree/main/x", "a/b"), ("ssh://git@github.com/a/b.git", "a/b"),
])
def test_repository_urls(spark, url, want):
    assert one(spark, tx.github_repo(F.col("u")), u=url) == want


def test_versions_are_ordered(spark):
    rows = [("n", v) for v in ("1.0.0-rc.2", "1.0.0-rc.10", "0.9.9", "1.0.0-alpha", "0.10.1.5")]
    from quarrylight.operators.dependencies import latest_versions

    df = spark.createDataFrame(rows, "name string, version string")
    assert latest_versions(df).first()["version"] == "0.10.1.5"
    assert latest_versions(df.where("version like '1.0.0-%'")).first()["version"] == "1.0.0-rc.10"


CORPUS = ["the quick brown fox", "the lazy dog and the fox", "Café fox fox", "nothing of the kind here", "quick quick the"]


def test_bm25_is_that_of_a_full_text_index(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this build")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(CORPUS))
    chunks = spark.createDataFrame(list(enumerate(CORPUS)), "id long, text string")
    for query in ("quick fox", "the", "the the cafe", "quick quick lazy"):
        words = " OR ".join(f'"{w}"' for w in query.split())
        want = {i: -s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (words,))}
        queries = spark.createDataFrame([(0, query)], "query_id int, query string")
        got = {r["id"]: r["score"] for r in rk.bm25_scores(rk.postings(chunks, ["id"]), rk.corpus_stats(chunks), queries, ["id"]).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)


def test_fusion_sums_reciprocal_ranks_and_breaks_ties(spark):
    v = spark.createDataFrame([(0, "r", 1, 1, 0.9), (0, "r", 2, 2, 0.8)], "query_id int, repo string, id int, rank int, score double")
    b = spark.createDataFrame([(0, "r", 1, 2, 5.0), (0, "r", 3, 1, 6.0), (0, "s", 9, 1, 1.0)], v.schema)
    rows = rk.fused_window(rk.fuse(v, b, ["repo", "id"])).orderBy("fused_pos").collect()
    assert [(r["id"], round(r["rrf"], 12)) for r in rows] == [(1, round(1 / 61 + 1 / 62, 12)), (3, round(1 / 61, 12)), (9, round(1 / 61, 12)), (2, round(1 / 62, 12))]


def test_pages_and_failed_scorer(spark):
    window = spark.createDataFrame([(0, i, f"text {i} fox" if i == 3 else f"text {i}", i, 0.5, 1.0, 0.1) for i in range(1, 6)], "query_id int, id int, text string, fused_pos int, vector_score double, bm25_score double, rrf double")
    queries = spark.createDataFrame([(0, "Fox? fox")], "query_id int, query string")
    ordered = rk.reranked(window, queries)
    assert [r["id"] for r in rk.page(ordered, 2).orderBy("pos").collect()] == [3, 1]
    assert rk.page(ordered, 99, 5).collect() == [] and len(rk.page(ordered, 0).collect()) == 1
    failed = rk.page(rk.reranked(window, queries, F.lit(None).cast("double")), 8).orderBy("pos").collect()
    assert [r["id"] for r in failed] == [1, 2, 3, 4, 5] and {r["effective_score"] for r in failed} == {0.5}


def test_too_many_queries_are_refused(spark):
    with pytest.raises(ValueError):
        rk.checked(spark.range(11), 10)
