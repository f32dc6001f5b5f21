"""The questions that a client asks, over a store: each returns a table of rows and an envelope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.config import DEFAULT
from quarrylight.functions.text import WIKI_BASE, index_tokens
from quarrylight.operators import ranking
from quarrylight.operators.citations import cited
from quarrylight.operators.dependencies import detect_frameworks, resolve_and_probe, resolve_repos
from quarrylight.operators.documents import chunks as chunked
from quarrylight.operators.documents import contents, serialized, subtree
from quarrylight.operators.graph import canonical_order, extract_edges, find_neighbours, ready, semantic_order
from quarrylight.operators.lexical import question
from quarrylight.operators.lexical import topk as lexical_topk
from quarrylight.operators.lexical import totals as lexical_totals
from quarrylight.operators.scratch import checkpointed
from quarrylight.operators.vector_search import nearest
from quarrylight.plans.inventory import inventory_page, project_dependencies
from quarrylight.plans.store import Store
from quarrylight.schemas import CHUNK_KEY


def hashed_embedding(dimension: int) -> Callable[[Column], Column]:
    """The encoder without a model: tokens hashed to signed places, of unit length. Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(tokens: pd.Series) -> pd.Series:
        import zlib

        out = []
        for words in tokens:
            v = np.zeros(dimension, np.float32)
            for w in words if words is not None else ():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return lambda text: encode(index_tokens(text))


@dataclass
class Answer:
    """Rows and what is known about them."""

    status: str
    rows: DataFrame | None = None
    envelope: dict = field(default_factory=dict)


class Engine:
    """Answers from a store. The clock, the encoder and the scorer are arguments."""

    def __init__(self, spark: SparkSession, store: Store, encode: Callable[[Column], Column] | None = None, score: Callable[[Column, Column], Column] | None = None, base: str = WIKI_BASE):
        self.spark, self.store, self.base = spark, store, base
        self.encode, self.score = encode or hashed_embedding(store.dimension), score

    def index(self, repo: str, nodes: DataFrame, now_ms: int, commit_sha: str | None) -> Answer:
        """Chunks, encodes and links a page and makes the build visible. An empty page has a status with no chunks; a
        page without a full commit is not indexed."""
        empty = nodes.isEmpty()
        if not empty and (commit_sha is None or len(commit_sha) != 40):
            return Answer("retry")
        cut = chunked(nodes)
        rows = cut.withColumns({"embedding": self.encode(F.col("text")), "indexed_at_ms": F.lit(now_ms).cast("long"), "commit_sha": F.lit(commit_sha).cast("string")})
        edges = extract_edges(nodes, self.base).withColumns({"commit_sha": F.coalesce(F.lit(commit_sha).cast("string"), F.lit("")), "indexed_at_ms": F.lit(now_ms).cast("long")})
        self.store.rebuild(repo, rows.repartition(1), canonical_order(edges), now_ms, commit_sha)
        return Answer("ready")

    def find_chunks(self, queries: DataFrame, now_ms: int, repo: str | None = None, k: int = DEFAULT.default_k, offset: int = 0, lexical: bool = True) -> Answer:
        """queries (query_id, query) to cited chunks, hybrid if the lexical index is asked for. The envelope has degraded (the
        scorer failed), queries (a row a query: counts, totals, mode and reason, truncated, and status, which is retry if a
        row of its window has no full commit; such queries have no rows) and repos (counts, mode and reason by query and repository)."""
        status = self.store.status()
        if status.isEmpty():
            return Answer("no_docs")
        repos = status.where(F.col("repo") == repo) if repo else ranking.target_repos(status, now_ms)
        if repos.isEmpty():
            return Answer("index_building" if repo else "no_match")
        chunks = self.store.chunks()
        names = F.broadcast(repos.select("repo"))
        targets = chunks.join(names, "repo", "left_semi")
        state = checkpointed(self.store.lexical_state().join(names, "repo", "left_semi"))
        # A repository whose postings can't be used is answered by vectors alone; the others stay hybrid.
        index, stats = self.store.postings()
        own = index.join(F.broadcast(state.where("reason is null").select("repo")), "repo", "left_semi") if lexical else index.where("false")
        v = checkpointed(nearest(targets, queries.withColumn("vector", self.encode(F.col("query"))), CHUNK_KEY, DEFAULT.window))
        asking = question((own, stats), queries)
        b = checkpointed(lexical_topk(asking, CHUNK_KEY, DEFAULT.window).rows)
        window = ranking.fused_window(ranking.fuse(v, b, CHUNK_KEY))
        # A few rows a query, which the scorer, the check of commits and the page all read.
        with_text = checkpointed(window.join(chunks.select(*CHUNK_KEY, "text", "commit_sha", "github_path"), CHUNK_KEY))
        score = self.score(F.col("query"), F.col("text")) if self.score else None
        ordered = ranking.reranked(with_text, queries, score)
        degraded = False
        if score is not None:
            # The window is small; a scorer that fails shows here, and the fused order stays.
            try:
                ordered.agg(F.max("rerank_score")).collect()
            except Exception:
                ordered, degraded = ranking.reranked(with_text, queries, F.lit(None).cast("double")), True
        # Every chunk with a vector has a score, so its total is the same for each query.
        sizes = targets.where("embedding is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("vector_total"))
        totals = sizes.join(ranking.checked(queries.select("query_id"))).join(lexical_totals(asking, CHUNK_KEY), ["query_id", "repo"], "full").fillna(0)
        per_repo = checkpointed(ranking.repository_modes(state, queries, v, b, totals, lexical, CHUNK_KEY))
        states = checkpointed(ranking.citation_state(ordered))
        info = queries.select("query_id").join(ranking.envelope(per_repo, window), "query_id", "left").join(states, "query_id", "left").fillna("ok", ["status"])
        envelope = {"degraded": degraded, "queries": info, "repos": per_repo}
        sound = states.where("status = 'ok'")
        if sound.isEmpty() and not states.isEmpty():
            return Answer("retry", envelope=envelope)
        rows = cited(ranking.page(ordered.join(sound.select("query_id"), "query_id", "left_semi"), k, offset), now_ms, self.base)
        return Answer("ready", rows, envelope)

    def ensure_indexed(self, repo: str, fetch: Callable[[str], tuple[DataFrame, str | None]], now_ms: int, ttl_ms: int = DEFAULT.index_ttl_ms) -> Answer:
        """Builds the index of a repository that has none or a stale one; fetch gives its nodes and commit."""
        known = self.store.status().where((F.col("repo") == repo) & (F.col("indexed_at_ms") > now_ms - ttl_ms) & (F.col("edge_count") >= 0))
        if not known.isEmpty():
            return Answer("cached")
        nodes, commit = fetch(repo)
        return self.index(repo, nodes, now_ms, commit)

    def list_dependencies(self, files: DataFrame, registry: DataFrame, wiki_status: DataFrame, include_dev: bool = DEFAULT.include_dev, include_optional: bool = DEFAULT.include_optional, primary_only: bool = True, offset: int = 0, limit: int = 50) -> Answer:
        """files (path, content) of a project to a page of its first scan's dependencies (and all of the others, unless ``primary_only``), with versions,
        repositories and wikis. The envelope has manifests (a row a scan: its root, type and number of dependencies), frameworks
        (of each scan) and errors (manifests that do not parse)."""
        scanned = project_dependencies(files, include_dev, include_optional)
        if scanned.isEmpty():
            return Answer("no_manifest")
        found = scanned.where("name is not null").drop("error")
        repos = checkpointed(resolve_repos(found.select("name", "ecosystem").distinct(), registry))
        probed = resolve_and_probe(found, repos.withColumn("query", F.col("name")), wiki_status)
        rows = inventory_page(probed, primary_only, offset, limit)
        manifests = scanned.groupBy("manifest_idx", "project_root", "manifest_type").agg(F.count("name").alias("total"))
        # Members of a scan are told apart by their place: the first dependency that shows a framework counts.
        order = (F.col("file_pos").cast("long") * 2**31 + F.col("pos")).alias("pos")
        frameworks = detect_frameworks(found.select(F.col("manifest_idx").alias("project"), "name", "ecosystem", order)).withColumnRenamed("project", "manifest_idx").drop("pos")
        return Answer("ready", rows, {"manifests": manifests, "frameworks": frameworks, "errors": scanned.where("error is not null").select("manifest_path", "error")})

    def resolve_repo(self, names: DataFrame, registry: DataFrame, wiki_status: DataFrame) -> Answer:
        """names (name, ecosystem) to their repositories, with whether they have a wiki; null where none was found or probed."""
        repos = checkpointed(resolve_repos(names.select("name", "ecosystem").distinct(), registry))
        return Answer("ready", resolve_and_probe(names, repos.withColumn("query", F.col("name")), wiki_status))

    def find_neighbours(self, kind: str, query: str | None = None, **args) -> Answer:
        """One-hop neighbours; with a query, by likeness to it."""
        if ready(self.store.status()).isEmpty():
            return Answer("no_docs", envelope={"reason": "no_indexed_repos"})
        rows = find_neighbours(self.store.edges(), self.store.status(), kind, **args)
        if query and kind != "cross_repo":
            sections = self.store.chunks().groupBy(F.concat("repo", F.lit("#"), "section_slug").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "text")))["text"], "\n\n").alias("text"))
            other = F.when(F.col("direction") == "in", F.col("src_id")).otherwise(F.col("dst_id")) if "direction" in rows.columns else F.col("dst_id")
            wanted = rows.withColumn("node_id", other)
            vectors = sections.join(wanted.select("node_id").distinct(), "node_id", "left_semi").select("node_id", self.encode(F.col("text")).alias("vector"))
            target = self.spark.createDataFrame([(query,)], "q string").select(self.encode(F.col("q")).alias("v")).first()["v"]
            rows = semantic_order(wanted, vectors, target)
        return Answer("ready", rows)

    def get_page(self, nodes: DataFrame, repo: str, commit_sha: str | None, slug: str | None = None, subsection: str | None = None, max_tokens: int = DEFAULT.page_tokens, list_pages: bool = False, prepare_only: bool = False, now_ms: int = 0) -> Answer:
        """A page as Markdown with its citation. A slug is checked and moves the anchor; a subsection cuts the page."""
        if list_pages and prepare_only:
            raise ValueError("a list of pages and preparation exclude each other")
        own = nodes.where(F.col("repo") == repo)
        if own.isEmpty():
            return Answer("no_docs", envelope={"fallback_urls": [f"https://github.com/{repo}", f"https://raw.githubusercontent.com/{repo}/HEAD/README.md"]})
        if list_pages:
            return Answer("ready", contents(own))
        if prepare_only:
            return self.index(repo, own, now_ms, commit_sha)
        wanted = [s for s in (slug, subsection) if s]
        if own.where("type = 'heading'").where(F.col("slug").isin(wanted)).select("slug").distinct().count() < len(set(wanted)):
            return Answer("no_match")
        if commit_sha is None or len(commit_sha) != 40:
            return Answer("retry")
        anchor = subsection or slug
        citation = self.spark.createDataFrame([(repo, f"{self.base}{repo}" + (f"#{anchor}" if anchor else ""), commit_sha)], "repo string, source_url string, commit_sha string")
        return Answer("ready", serialized(subtree(own, subsection) if subsection else own, citation, max_tokens))
