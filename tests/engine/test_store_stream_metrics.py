import datetime
import json
import math
import re
import shutil
import time

import pytest
from pyspark.sql import functions as F

from quarrylight.config import Config
from quarrylight.operators import metrics as me
from quarrylight.operators import ranking
from quarrylight.plans import output
from quarrylight.plans.engine import Engine
from quarrylight.plans.queries import QUERIES
from quarrylight.plans.store import Store, migrated, upserted
from quarrylight.schemas import CHUNK_KEY
from quarrylight.streaming import feeds
from quarrylight.streaming.heartbeat import Heartbeat
from tests.engine.test_documents_and_graph import SHA, TREE, nodes_of


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Store(spark, str(tmp_path / "store"), 64))


def test_index_and_ask(spark, engine):
    queries = spark.createDataFrame([(0, "deep"), (1, "setup file")], "query_id int, query string")
    assert engine.find_chunks(queries, 10).status == "no_docs"
    nodes = nodes_of(spark, TREE)
    assert engine.index("o/r", nodes, 1000, None).status == "retry"
    for now in (1000, 2000):
        assert engine.index("o/r", nodes, now, SHA).status == "ready"
    status = engine.store.status().collect()
    assert [(r["repo"], r["chunk_count"], r["edge_count"], r["indexed_at_ms"]) for r in status] == [("o/r", 3, 8, 2000)]
    assert engine.store.chunks().count() == 3 and engine.store.edges().count() == 8
    rows = engine.find_chunks(queries, 3000, k=1).rows.collect()
    assert {(r["query_id"], r["section_slug"]) for r in rows} >= {(0, "setup-deep")} and all(r["text"].endswith(f"commit {SHA})*") for r in rows)
    assert engine.find_chunks(queries, 3000 + 10**9).status == "no_match"
    assert engine.find_chunks(queries, 3000 + 10**9, repo="o/r").status == "ready"
    near = engine.find_neighbours("section_links", repo="o/r", section_slug="intro", query="setup")
    assert [r["dst_id"] for r in near.rows.collect()] == ["o/r#setup"]


def test_envelope_of_answers(spark, engine):
    engine.index("o/r", nodes_of(spark, TREE), 1000, SHA)
    queries = spark.createDataFrame([(0, "deep"), (1, "??"), (2, "setup")], "query_id int, query string")
    answer = engine.find_chunks(queries, 2000)
    info = {r["query_id"]: r for r in answer.envelope["queries"].collect()}
    assert [(info[i]["mode"], info[i]["reason"], info[i]["status"], info[i]["truncated"]) for i in range(3)] == [("hybrid", None, "ok", False), ("vector_only", "empty_query_tokens", "ok", False), ("hybrid", None, "ok", False)]
    assert info[0]["union_total"] == 3 and info[0]["total"] == 3
    assert {(r["query_id"], r["repo"], r["vector_total"]) for r in answer.envelope["repos"].collect()} == {(i, "o/r", 3) for i in range(3)}
    flat = engine.find_chunks(queries, 2000, lexical=False)
    assert {(r["mode"], r["reason"]) for r in flat.envelope["queries"].collect()} == {("vector_only", "force_no_bm25")}


def test_a_bad_commit_holds_back_its_queries_only(spark, engine):
    engine.index("o/r", nodes_of(spark, TREE), 1000, SHA)
    chunks = engine.store.chunks()
    engine.store.rebuild("o/s", chunks.where("section_slug = 'setup'").withColumn("commit_sha", F.lit("short")), engine.store.edges().where("false"), 1000, SHA)
    queries = spark.createDataFrame([(0, "deep")], "query_id int, query string")
    assert engine.find_chunks(queries, 2000).status == "retry" and engine.find_chunks(queries, 2000, repo="o/r").status == "ready"


def test_ensure_indexed(spark, engine):
    calls = []

    def fetch(repo):
        calls.append(repo)
        return nodes_of(spark, TREE), SHA

    assert [engine.ensure_indexed("o/r", fetch, now, 100).status for now in (10, 50, 200)] == ["ready", "cached", "ready"]
    assert calls == ["o/r", "o/r"]


def test_inventory_of_a_project(spark, engine):
    def pom(name, inner, kind=""):
        g, a, v = name.split(":")
        return f"<project><groupId>{g}</groupId><artifactId>{a}</artifactId><version>{v}</version>{kind}{inner}</project>"

    entry = lambda g, a, v, more="": f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId>" + (f"<version>{v}</version>" if v else "") + f"{more}</dependency>"
    managed = lambda *entries: f"<dependencyManagement><dependencies>{''.join(entries)}</dependencies></dependencyManagement>"
    deps = f"<dependencies>{entry('g', 'x', None)}{entry('g', 'y', None)}{entry('g', 'z', '1')}</dependencies>"
    files = [
        ("web/package.json", '{"dependencies":{"react":"18"},"devDependencies":{"jest":"1"},"workspaces":["packages/*"]}'), ("web/packages/a/package.json", '{"dependencies":{"react":"17","axon-x":"1"}}'), ("web/packages/b/package.json", "{"),
        ("web/node_modules/x/package.json", '{"dependencies":{"hidden":"1"}}'), ("web/requirements.txt", "flask"),
        ("x/java/pom.xml", pom("o:app:1", managed(entry("b", "bom", "1", "<type>pom</type><scope>import</scope>")) + deps, "<parent><groupId>p</groupId><artifactId>up</artifactId><version>1</version></parent>")),
        ("x/parent/pom.xml", pom("p:up:1", managed(entry("g", "x", "5"), entry("g", "y", "6")))), ("x/bom/pom.xml", pom("b:bom:1", managed(entry("g", "y", "7")))),
        ("x/net/A.csproj", '<Project><ItemGroup><PackageReference Include="Lib"/></ItemGroup></Project>'),
        ("x/net/Directory.Packages.props", '<Project><ItemGroup><PackageVersion Include="Lib" Version="3"/></ItemGroup></Project>'),
    ]
    table = spark.createDataFrame(files, "path string, content string")
    registry = spark.createDataFrame([("react", "npm", 200, '{"repository":{"url":"git+https://github.com/facebook/react.git"}}')], "name string, ecosystem string, http_status int, json string")
    wiki = spark.createDataFrame([("facebook/react", True, 9)], "repo string, has_wiki boolean, page_count int")
    answer = engine.list_dependencies(table, registry, wiki)
    assert [(r["name"], r["declared_version"], r["resolved"], r["has_wiki"], r["total"], r["manifests_total"]) for r in answer.rows.collect()] == [("react", "18", "facebook/react", True, 2, 6), ("axon-x", "1", "axon-x/axon-x", None, 2, 6)]
    assert [(r["manifest_idx"], r["framework"]) for r in answer.envelope["frameworks"].collect()] == [(0, "React")]
    assert [r["manifest_path"] for r in answer.envelope["errors"].collect()] == ["web/packages/b/package.json"]
    assert [tuple(r) for r in answer.envelope["manifests"].orderBy("manifest_idx").collect()] == [(0, "web", "package.json", 2), (1, "x/bom", "pom.xml", 0), (2, "x/java", "pom.xml", 3), (3, "x/net", "csproj", 1), (4, "x/parent", "pom.xml", 0)]
    whole = engine.list_dependencies(table, registry, wiki, include_dev=True, primary_only=False, offset=1, limit=1)
    assert [(r["manifest_path"], r["name"], r["declared_version"], r["total"]) for r in whole.rows.collect()] == [
        ("web/package.json", "jest", "1", 3), ("x/java/pom.xml", "g:x", "5", 3), ("x/java/pom.xml", "g:y", "7", 3), ("x/java/pom.xml", "g:z", "1", 3), ("x/net/A.csproj", "Lib", "3", 3)]
    assert engine.list_dependencies(table.where("path = 'bom/none'"), registry, wiki).status == "no_manifest"
    asked = spark.createDataFrame([("react", "npm"), ("unknown", "npm")], "name string, ecosystem string")
    assert {(r["name"], r["resolved"], r["page_count"]) for r in engine.resolve_repo(asked, registry, wiki).rows.collect()} == {("react", "facebook/react", 9), ("unknown", "unknown/unknown", None)}


def test_a_failing_scorer_degrades(spark, engine):
    engine.index("o/r", nodes_of(spark, TREE), 1000, SHA)
    queries = spark.createDataFrame([(0, "deep")], "query_id int, query string")
    engine.score = lambda query, text: F.raise_error(F.lit("no model")).cast("double")
    answer = engine.find_chunks(queries, 2000)
    rows = answer.rows.collect()
    assert answer.envelope["degraded"] and rows and all(r["rerank_score"] is None for r in rows)
    engine.score = lambda query, text: F.length(text).cast("double")
    answer = engine.find_chunks(queries, 2000)
    scores = [r["rerank_score"] for r in answer.rows.orderBy("pos").collect()]
    assert not answer.envelope["degraded"] and scores == sorted(scores, reverse=True)


def test_output_and_heartbeat(spark, tmp_path):
    import logging

    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r["value"] for r in output.as_json(rows).collect()] == ['{"a":1}', '{"a":2,"b":"x"}']
    output.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    log = output.json_log(str(tmp_path / "log"), 400, 2)
    for i in range(20):
        log.info("built", extra={"fields": {"repo": "o/r", "n": i}})
    logging.shutdown()
    assert len(list(tmp_path.glob("log*"))) == 3 and json.loads((tmp_path / "log").read_text().splitlines()[-1])["n"] == 19
    beat = Heartbeat()
    spark.streams.addListener(beat)
    rows.write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(50):
        if beat.beats and beat.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(beat)
    assert sum(b[2] for b in beat.beats) == 2 and beat.ended[0][1] is None


def test_pages(spark, engine):
    nodes = nodes_of(spark, TREE)
    assert engine.get_page(nodes, "x/y", SHA).status == "no_docs"
    assert engine.get_page(nodes, "o/r", SHA, slug="none").status == "no_match"
    assert engine.get_page(nodes, "o/r", "short").status == "retry"
    whole, part = (engine.get_page(nodes, "o/r", SHA, **a).rows.first()["markdown"] for a in ({"slug": "setup"}, {"subsection": "setup"}))
    assert "## Intro" in whole and "## Intro" not in part and "o/r#setup (" in whole
    with pytest.raises(ValueError):
        engine.get_page(nodes, "o/r", SHA, list_pages=True, prepare_only=True)


def test_store_rules(spark, engine):
    store = engine.store
    engine.index("o/r", nodes_of(spark, TREE), 1, SHA)
    with pytest.raises(Exception, match="dimension"):
        store.rebuild("o/r", store.chunks().withColumn("embedding", F.array(F.lit(1.0).cast("float"))), store.edges(), 5, SHA)
    assert store.chunks().count() == 3
    assert not store.check_embedder("hash") and not store.check_embedder("hash")
    engine.index("o/r", nodes_of(spark, TREE), 2, SHA)
    store.forget_graphs()
    assert store.status().first()["edge_count"] == -1
    store.touch("o/r", 9)
    assert store.status().first()["indexed_at_ms"] == 9
    linked = store.edges().count()
    assert store.check_embedder("another") and not store.has_any() and store.edges().count() == linked > 0
    engine.index("o/r", nodes_of(spark, TREE), 3, SHA)
    store.drop("o/r", 4)
    assert store.chunks().count() == 0 and store.repos().collect() == [] and store.edges().count() == 0


def test_postings_of_the_store_are_those_of_its_chunks(spark, engine):
    store = engine.store
    for n, repo in enumerate(("o/r", "o/s")):
        engine.index(repo, nodes_of(spark, TREE).withColumn("repo", F.lit(repo)), n, SHA)
    engine.index("o/s", nodes_of(spark, TREE).withColumn("repo", F.lit("o/s")), 5, SHA)
    want, stats = ranking.postings(store.chunks(), CHUNK_KEY), ranking.corpus_stats(store.chunks()).first()
    key = lambda r: tuple(r[c] for c in ("repo", "section_slug", "ordinal", "dl", "term", "tf"))
    index, found = store.postings()
    assert sorted(map(key, index.select("repo", "term", F.inline("docs")).collect())) == sorted(map(key, want.collect()))
    assert (found.first()["n_chunks"], round(found.first()["avgdl"], 9)) == (stats["n_chunks"], round(stats["avgdl"], 9))
    assert store.backfill_postings() == 0
    for table in ("postings", "lengths"):
        shutil.rmtree(f"{store.folder}/{table}")
    assert store.postings()[0].isEmpty() and store.backfill_postings() == 2
    assert sorted(map(key, store.postings()[0].select("repo", "term", F.inline("docs")).collect())) == sorted(map(key, want.collect()))


def test_migration_and_upsert(spark):
    rows = spark.range(200).withColumn("failed", F.col("id") == 0)
    assert migrated(rows, "failed").count() == 199
    with pytest.raises(ValueError):
        migrated(rows.where("id < 100"), "failed")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 0)], "id int, v string, turn int")
    assert sorted(map(tuple, upserted(table, changes, ["id"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_percentiles_and_means(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([4, 1, 3, 2])] + [("b", i, float(i)) for i in range(1200)], "k string, i int, value double")
    got = {r["k"]: r for r in me.buckets(rows, ["k"], ["i"]).collect()}
    assert (got["a"]["p50"], got["a"]["p95"], got["b"]["n"], got["b"]["p50"], got["b"]["lowest"]) == (3.0, 4.0, 1200, 700.0, 0.0)
    builds = spark.createDataFrame([(i, i != 3, float(i)) for i in range(15)], "ts int, ok boolean, ms double")
    assert me.expected_build_ms(builds).first()[0] == sum(range(5, 15)) / 10
    assert me.expected_build_ms(builds.where("false")).first()[0] == 8000.0


def test_quality_measures(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "query_id int, item string, pos int")
    relevant = spark.createDataFrame([(0, "b"), (0, "z"), (1, "q")], "query_id int, item string")
    got = {r["query_id"]: r for r in me.ndcg(ranked, relevant).collect()}
    assert math.isclose(got[0]["ndcg"], (1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got[0]["recall"] == 0.5 and not got[0]["hit"] and got[1]["ndcg"] == 0
    expected = spark.createDataFrame([(0, "a", 1), (0, "c", 2)], "query_id int, item string, place int")
    assert tuple(me.ordering_score(ranked, expected).first()) == (0, 0.5, 1)


def test_items_relevant_to_every_query_make_no_pairs(spark):
    """The same measures as of the pairs written out, from a plan without a row a pair."""
    ranked = spark.createDataFrame([(q, i, n) for q in range(6) for n, i in enumerate(range(q, q + 12), 1)] + [(9, 1, 1)], "query_id long, item long, pos int")
    items = spark.createDataFrame([(3,), (5,), (5,), (40,), (None,)], "item long")
    queries = spark.range(8).withColumnRenamed("id", "query_id")
    got = me.ndcg(ranked, items, 4, queries)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, me.ndcg(ranked, queries.join(items), 4).collect())) and got.count() == 8
    assert me.ndcg(ranked, items.where("false"), 4, queries).collect() == []
    plan = QUERIES["ndcg_recall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (Inner|Cross)\s*(, rightHint|, leftHint|$)", plan, re.M)


def test_watcher(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    t = lambda s: f"2024-01-01T00:00:{s:02d}Z"
    batches = [
        [("a/package.json", "add", t(0), '{"dependencies": {"x": "1", "y": "1"}}')],
        [("a/package.json", "unlink", t(1), None)],
        [("a/package.json", "change", t(2), '{"dependencies": {"z": "1"}}'), ("a/package.json", "change", t(3), '{"dependencies": {"x": "2"}}')],
        [("a/package.json", "gone", t(4), None)],
    ]
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("path", "event_type", "ts", "content"), r, strict=True))) for r in rows))
        import os

        os.utime(source / f"{i}.json", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    repos = spark.createDataFrame([("x", "npm", "o", "x"), ("y", "npm", "o", "y")], "query string, ecosystem string, owner string, repo string")
    seen = []
    watcher = feeds.ManifestWatcher(spark, str(tmp_path / "state"), repos, lambda gone, orphans: seen.append((sorted(r["name"] for r in gone.collect()), sorted(r["resolved"] for r in orphans.collect()))))
    query = watcher.start(feeds.file_events(spark, str(source)), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(300)
    assert seen == [([], []), ([], []), (["y"], ["o/y"]), (["x"], ["o/x"])]


def test_streamed_windows_and_percentiles(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(begin + datetime.timedelta(seconds=7 * i), "ab"[i % 2], float(i * 37 % 100)) for i in range(120)]
    samples = spark.createDataFrame(rows, "ts timestamp, name string, value double")
    for part in range(3):
        samples.where(f"unix_timestamp(ts) % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}
    for name, df, mode in (("windows", feeds.tumbling(stream, ["name"], late="1 hour"), "complete"), ("percentiles", feeds.running_percentiles(stream, "name"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        out[name] = spark.table(name).collect()
    assert sorted(map(tuple, out["windows"])) == sorted(map(tuple, feeds.tumbling(samples, ["name"]).collect()))
    last = {k: max((r for r in out["percentiles"] if r["name"] == k), key=lambda r: r["n"]) for k in "ab"}
    whole = {r["name"]: r for r in me.buckets(samples, ["name"], ["ts"]).collect()}
    assert all((last[k]["n"], last[k]["p50"], last[k]["p95"]) == (whole[k]["n"], whole[k]["p50"], whole[k]["p95"]) for k in "ab")


def test_breaker_and_settings(monkeypatch):
    b = feeds.Breaker(60)
    calls = []

    def fail():
        calls.append(1)
        raise RuntimeError

    assert [b.call(t, fail, lambda: "degraded") for t in (0, 30, 59, 61)] == ["degraded"] * 4 and len(calls) == 2
    assert b.call(200, lambda: "ok", lambda: "degraded") == "ok"
    for name, value in (("RRF_K", "30"), ("WINDOW", "x"), ("INCLUDE_DEV", "yes"), ("SPLIT_QUERY", "maybe")):
        monkeypatch.setenv("QUARRYLIGHT_" + name, value)
    c = Config.from_env()
    assert (c.rrf_k, c.window, c.include_dev, c.split_query) == (30, 50, True, False)
