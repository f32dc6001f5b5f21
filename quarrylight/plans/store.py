"""The index as Parquet tables. A build is written to folders of its own, and becomes visible when its status row is
written, last; a build that breaks off leaves nothing that a reader sees.

chunks/, edges/, postings/, lengths/: repo=.../build_id=.... status/: append only, the latest row of a repository counts. meta/: the same by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarrylight import schemas
from quarrylight.operators import lexical
from quarrylight.operators.dependencies import first_wins
from quarrylight.operators.scratch import checkpointed

STATUS = schemas.STATUS + ", written long"
BLOCK = "term string, repo string, segment long, n long, max_tf int, min_dl int, docs array<struct<page_slug: string, section_slug: string, ordinal: int, tf: int, dl: int>>"
LENGTHS = "repo string, n_chunks long, tokens long, n_blocks long"
META = "key string, value string, written long"


def latest(rows: DataFrame, key: list[str], order: str = "written") -> DataFrame:
    return first_wins(rows, key, [F.col(order).desc()])


class Store:
    """Tables under one folder, for one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int):
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, rows: list[tuple], table: str, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def status(self, removed: bool = False) -> DataFrame:
        rows = latest(self._read("status", STATUS), ["repo"])
        return rows if removed else rows.where("build_id is not null")

    def _visible(self, table: str, schema: str) -> DataFrame:
        builds = self.status().select("repo", "build_id")
        # One row a repository; Spark broadcasts it if it is small and prunes partitions by it.
        return self._read(table, f"{schema}, build_id string").join(builds, ["repo", "build_id"], "left_semi").drop("build_id")

    def chunks(self) -> DataFrame:
        return self._visible("chunks", schemas.CHUNK)

    def edges(self) -> DataFrame:
        """Also those of repositories whose chunks another encoder has made invisible: only a dropped one has a negative number of chunks."""
        rows = self._read("status", STATUS)
        now = latest(rows, ["repo"]).where("build_id is not null or chunk_count >= 0").select("repo")
        builds = latest(rows.where("build_id is not null"), ["repo"]).join(now, "repo", "left_semi").select("repo", "build_id")
        return self._read("edges", f"{schemas.EDGE}, build_id string").join(builds, ["repo", "build_id"], "left_semi").drop("build_id")

    def _blocks(self) -> DataFrame:
        """The blocks of all builds that can be read; a file that can't be read has none."""
        try:
            return self.spark.read.schema(f"{BLOCK}, build_id string").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{self.folder}/postings")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{BLOCK}, build_id string")

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """The lexical index (blocks, statistics) of all visible chunks."""
        sums = self._visible("lengths", LENGTHS).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        builds = self.status().select("repo", "build_id")
        visible = self._blocks().join(builds, ["repo", "build_id"], "left_semi").drop("build_id")
        return visible, sums.select("n_chunks", (F.col("tokens") / F.greatest(F.col("n_chunks"), F.lit(1))).alias("avgdl"))

    def lexical_state(self) -> DataFrame:
        """A row a visible repository: repo, reason why its postings can't be used, or null. They can't if none were written or
        if blocks of them are lost. Only the narrow columns of blocks are read."""
        builds = self.status().where("chunk_count > 0").select("repo", "build_id")
        there = self._blocks().groupBy("repo", "build_id").agg(F.count("segment").alias("found"))
        wanted = self._read("lengths", f"{LENGTHS}, build_id string").select("repo", "build_id", "n_blocks")
        joined = builds.join(wanted, ["repo", "build_id"], "left").join(there, ["repo", "build_id"], "left")
        reason = F.when(F.col("n_blocks").isNull(), "no_postings").when(F.coalesce("found", F.lit(0)) != F.col("n_blocks"), "damaged_postings")
        return joined.select("repo", reason.alias("reason"))

    def _write_postings(self, chunks: DataFrame) -> None:
        """chunks (repo, build_id, ...): their blocks, sorted by term, and their lengths, which come last and make them count."""
        by, item = ["repo", "build_id"], schemas.CHUNK_KEY[1:]
        indexed = checkpointed(lexical.forward(chunks, [*by, *item]))
        made = checkpointed(lexical.blocks(indexed, by, item))
        made.sortWithinPartitions(*by, "term").write.mode("append").partitionBy(*by).parquet(f"{self.folder}/postings")
        sums = indexed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        lengths = sums.join(made.groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks")), by, "left").fillna(0, ["n_blocks"])
        lengths.write.mode("append").partitionBy(*by).parquet(f"{self.folder}/lengths")

    def backfill_postings(self) -> int:
        """Indexes the visible builds that were written without postings; returns how many."""
        done = self._read("lengths", f"{LENGTHS}, build_id string").select("build_id").distinct()
        builds = [r["build_id"] for r in self.status().where("chunk_count > 0").select("build_id").join(done, "build_id", "left_anti").collect()]
        if builds:
            self._write_postings(self._read("chunks", f"{schemas.CHUNK}, build_id string").where(F.col("build_id").isin(builds)))
        return len(builds)

    def rebuild_many(self, chunks: DataFrame, edges: DataFrame, builds: DataFrame, now_ms: int) -> str:
        """Replaces the chunks and edges of every repository of ``builds`` (repo, commit_sha) together: one write of each table, and one append of status
        rows, which makes them all visible. Vectors of a wrong dimension are an error."""
        build = uuid.uuid4().hex
        builds = checkpointed(builds.select("repo", "commit_sha"))
        checked = F.when(F.col("embedding").isNull() | (F.size("embedding") == self.dimension), F.col("embedding")).otherwise(
            F.raise_error(F.lit(f"a vector is not of dimension {self.dimension}")).cast("array<float>"))
        for rows, table in ((chunks.withColumn("embedding", checked), "chunks"), (edges, "edges")):
            rows.join(builds.select("repo"), "repo", "left_semi").withColumn("build_id", F.lit(build)).write.mode("append").partitionBy("repo", "build_id").parquet(f"{self.folder}/{table}")
        own = lambda table, schema: self._read(table, f"{schema}, build_id string").where(F.col("build_id") == build)
        self._write_postings(own("chunks", schemas.CHUNK))
        counted = lambda table, schema, name: own(table, schema).groupBy("repo").agg(F.count(F.lit(1)).cast("int").alias(name))
        counts = builds.join(counted("chunks", schemas.CHUNK, "chunk_count"), "repo", "left").join(counted("edges", schemas.EDGE, "edge_count"), "repo", "left").fillna(0, ["chunk_count", "edge_count"])
        turn = F.lit(self._next("status", STATUS)).cast("long")
        status = counts.select("repo", F.lit(build).alias("build_id"), F.lit(now_ms).cast("long").alias("indexed_at_ms"), "commit_sha", "chunk_count", "edge_count", turn.alias("written"))
        status.coalesce(1).write.mode("append").parquet(f"{self.folder}/status")
        return build

    def rebuild(self, repo: str, chunks: DataFrame, edges: DataFrame, now_ms: int, commit_sha: str | None) -> str:
        """Replaces a repository's chunks and edges together."""
        builds = self.spark.createDataFrame([(repo, commit_sha)], "repo string, commit_sha string")
        return self.rebuild_many(chunks.withColumn("repo", F.lit(repo)), edges.withColumn("repo", F.lit(repo)), builds, now_ms)

    def set_status(self, repo: str, build: str | None, now_ms: int, commit_sha: str | None, n_chunks: int = 0, n_edges: int = -1) -> None:
        self._append([(repo, build, now_ms, commit_sha, n_chunks, n_edges, self._next("status", STATUS))], "status", STATUS)

    def _next(self, table: str, schema: str) -> int:
        return self._read(table, schema).agg(F.coalesce(F.max("written"), F.lit(0)) + 1).first()[0]

    def touch(self, repo: str, now_ms: int) -> None:
        """The same build, checked again."""
        row = self.status().where(F.col("repo") == repo).first()
        if row:
            self.set_status(repo, row["build_id"], now_ms, row["commit_sha"], row["chunk_count"], row["edge_count"])

    def drop(self, repo: str, now_ms: int) -> None:
        self.set_status(repo, None, now_ms, None, n_chunks=-1)

    def forget_graphs(self) -> None:
        """After a change of the extractor: all graphs count as not built."""
        rows, turn = self.status(), self._next("status", STATUS)
        rows.select("repo", "build_id", "indexed_at_ms", "commit_sha", "chunk_count", F.lit(-1).alias("edge_count"), F.lit(turn).cast("long").alias("written")).coalesce(1).write.mode("append").parquet(f"{self.folder}/status")

    def meta(self) -> DataFrame:
        return latest(self._read("meta", META), ["key"]).select("key", "value")

    def check_embedder(self, model: str) -> bool:
        """Notes the encoder; another model or dimension than before drops all chunks and statuses; edges stay. True if it did."""
        known = {r["key"]: r["value"] for r in self.meta().where(F.col("key").isin("embed_model", "embed_model_dim")).collect()}
        now = {"embed_model": model, "embed_model_dim": str(self.dimension)}
        if known == now:
            return False
        turn = self._next("status", STATUS)
        self.status().select("repo", F.lit(None).cast("string").alias("build_id"), "indexed_at_ms", F.lit(None).cast("string").alias("commit_sha"), F.lit(0).alias("chunk_count"), "edge_count", F.lit(turn).cast("long").alias("written")).coalesce(1).write.mode("append").parquet(f"{self.folder}/status")
        self._append([(k, v, self._next("meta", META)) for k, v in now.items()], "meta", META)
        return bool(known)

    def has_any(self) -> bool:
        return not self.status().isEmpty()

    def repos(self) -> DataFrame:
        return self.status().select("repo").orderBy("repo")


def migrated(rows: DataFrame, failed: str, most: float = 0.01) -> DataFrame:
    """Rows of a back-fill that did not fail; an error if too large a share did."""
    total, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(failed).cast("int")), F.lit(0))).first()
    if total and bad / total >= most:
        raise ValueError(f"{bad} of {total} rows failed")
    return rows.where(~F.col(failed)).drop(failed)


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows of the same key replaced by the changes, of which the last counts by ``turn``."""
    new = first_wins(changes, key, [F.col("turn").desc()]).drop("turn")
    return table.join(new.select(*key), key, "left_anti").unionByName(new)
