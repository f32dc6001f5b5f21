"""Exact dedup: a log-structured merge index over digests of normalised texts.

Every task that reads documents keeps its digests and ids in memory and flushes them as a sorted run with a Bloom filter
on the digest, a Parquet file; no row is shuffled for that. Compaction merges the runs into one level of sorted files
without overlap and keeps the smallest identifier of a digest, and how many documents hold it. Digests of one document
alone are done with. The texts of the others, the hits, are verified byte by byte against the text of the document that
stays. Before a text moves, its id is looked up in a bit filter of the hits' ids, so that only hits' texts (and the few that
the filter can't tell from them) are shuffled, once.

Scale: runs and levels hold 48 bytes a text and no texts. The bit filter is broadcast; it has 16 bits a hit and no more than
FILTER_BITS, 2**19 rows of two longs; where there are more hits than that tells apart, more texts move, and results are the
same. Digests with over a thousandth of all documents, of which there can be a thousand at most, are dealt out over salts,
with the text that stays copied to each salt. DataFrame operations only.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` is replaced by one space; null counts as empty.
A null id comes after all others and stays only if its group has no other id. Rows that repeat both id and text are each
counted and share one verdict. Should different texts share a digest, the documents of such digests are grouped by their
texts themselves. Columns of the input stay, but for those named like a result column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import NULL_ID, SHARE, order_id, scratch, written

#: Most bits of the filter that is broadcast, 64 to a row.
FILTER_BITS = 1 << 25
RUN, LEVEL = "digest binary, id long", "digest binary, keep_id long, n long"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """Runs in levels under one folder. Level 0 has the runs as flushed, level 1 what compaction made of them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = 4):
        self.spark, self.folder, self.fan_in = spark, folder or scratch(spark, "digests"), fan_in
        self.runs: list[str] = []
        self.level = ""
        self._made = 0

    def _write(self, rows: DataFrame, kind: str) -> str:
        self._made += 1
        path = f"{self.folder}/{kind}-{self._made:05d}"
        rows.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        return path

    def flush(self, digests: DataFrame) -> DataFrame:
        """digests (digest, id): the memtable of each task becomes a sorted run. Returns them as read back. Compacts when
        flushes have piled up."""
        path = self._write(digests.sortWithinPartitions("digest", "id"), "L0")
        self.runs.append(path)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return self.spark.read.schema(RUN).parquet(path)

    def compact(self) -> None:
        """Merges all runs into the next level; of a digest, the smallest identifier stays and counts add up."""
        if self.runs:
            self.level, self.runs = self._write(self._merged().sortWithinPartitions("digest"), "L1"), []

    def _merged(self) -> DataFrame:
        parts = [self.spark.read.schema(LEVEL).parquet(self.level)] if self.level else []
        if self.runs:
            parts.append(self.spark.read.schema(RUN).parquet(*self.runs).select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def lookup(self) -> DataFrame:
        """(digest, keep_id, n) over all levels."""
        return self._merged() if self.runs else self.spark.read.schema(LEVEL).parquet(self.level)

    def find(self, digest: bytes) -> DataFrame:
        """What is known of one digest; Parquet asks the Bloom filters which runs need to be read."""
        return self.lookup().where(F.col("digest") == F.lit(digest))


def bit_filter(ids: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A filter of n ids: rows of 64 bits (word, mask), and its number of bits."""
    bits = min(FILTER_BITS, 1 << max(6, math.ceil(math.log2(16 * n + 1))))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    masks = ids.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}L) % 64 as int))").alias("bit"))
    return masks.groupBy("word").agg(F.bit_or("bit").alias("mask")), bits


def may_be_in(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """The rows whose id the filter has, and a few others."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    keyed = rows.withColumns({"word": F.shiftright(at, 6), "place": (at % 64).cast("int")})
    # No more than FILTER_BITS / 64 rows are broadcast.
    return keyed.join(F.broadcast(words), "word").where(F.getbit("mask", F.col("place")) == 1).select(*rows.columns)


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256 (of the normalised text)."""
    index = DigestIndex(df.sparkSession)
    # Columns under names of this operator's own, so that no other can clash with them and those not asked for are not read.
    own = {c: f"__{i}" for i, c in enumerate(df.columns)}
    plain = df.toDF(*own.values())
    norm, id_ = normalised(own[text]), order_id(own[doc_id]).alias("id")
    sha = lambda column: F.sha2(column.cast("binary"), 256)
    digest = lambda column: F.substring(F.unhex(sha(column)), 1, digest_bytes)
    run = index.flush(plain.select(digest(norm).alias("digest"), id_))
    index.compact()
    level = index.lookup()
    total = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = level.where("n > 1")
    hot = F.broadcast(hits.where(F.col("n") * SHARE > total).select("digest", F.ceil(F.col("n") * SHARE / F.lit(max(1, total))).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    salted = lambda rows: rows.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("salts")
    spread = hits.join(hot, "digest", "left").select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "keep_id", "n", salts.alias("salts"))
    resolved = written(salted(run).join(spread, ["digest", "salt"], "left").select("id", "digest", "keep_id", F.coalesce("n", F.lit(1)).alias("n")), "digest-verdicts")
    members = resolved.where("n > 1").select("id")
    words, bits = bit_filter(members, members.count())
    texts = may_be_in(plain.select(id_, F.col(own[text])), words, bits).select("id", norm.alias("norm"))
    texts = salted(texts.withColumn("digest", digest(F.col("norm")))).join(spread, ["digest", "salt"])
    # Written so that it is no further key of the join above: both uses of the texts are then one shuffle.
    stays = texts.where(F.col("id").bitwiseXOR(F.col("keep_id")) == 0).groupBy("digest", "salts").agg(F.first("norm").alias("stays"))
    stays = stays.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "stays")
    differ = written(texts.join(stays, ["digest", "salt"]).where("norm <> stays").select("digest").distinct(), "collisions")
    out = {
        "keep_id": F.when(F.col("own") != NULL_ID, F.col("own")), "group_size": F.col("n").cast("long"), "kept": F.col("own") == F.col("id"),
        "text_sha256": F.lower(F.hex("digest")) if digest_bytes == 32 else sha(norm),
    }
    if not differ.isEmpty():
        found = _by_text(plain.withColumn("norm", norm).withColumns({"id": id_, "digest": digest(F.col("norm"))}), resolved, differ)
    elif resolved.groupBy("id").count().where("count > 1").isEmpty():
        found = plain.withColumn("id", id_).join(resolved, "id")
    else:
        once = resolved.groupBy("digest", "id").agg(F.first("keep_id").alias("keep_id"), F.first("n").alias("n"))
        found = plain.withColumns({"id": id_, "digest": digest(norm)}).join(once, ["digest", "id"])
    found = found.withColumn("own", F.coalesce("keep_id", "id"))
    taken = set(out)
    return found.select(*[F.col(own[c]).alias(c) for c in df.columns if c.lower() not in taken], *[c.alias(name) for name, c in out.items()])


def _by_text(rows: DataFrame, resolved: DataFrame, differ: DataFrame) -> DataFrame:
    """rows (with id, digest, norm) with keep_id and n, where different texts share the digests of ``differ``."""
    once = resolved.join(differ, "digest", "left_anti").groupBy("digest", "id").agg(F.first("keep_id").alias("keep_id"), F.first("n").alias("n"))
    alone = rows.join(differ, "digest", "left_anti").join(once, ["digest", "id"])
    shared = rows.join(differ, "digest", "left_semi")
    groups = shared.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return alone.unionByName(shared.join(groups, ["digest", "norm"]))
