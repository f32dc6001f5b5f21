r"""Line dedup: lines that several documents hold stay only in the one with the smallest id.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends, A-Z lower-cased; keys of at least ``min_chars`` code
points count. Keys are known by 128-bit hashes, and each text is hashed once. The distinct hashes of all lines are dealt
into shards; each shard is indexed by a minimal perfect hash over its hashes, with compact arrays by slot: fingerprints of
32 bits, document counts of 8 bits (which stop at 255) and first documents. Documents send their line hashes to the shards,
which probe the arrays and answer with the hashes that the document must drop; lines themselves are never joined or
shuffled. As all lines are indexed, a probe meets its own slot, and a fingerprint that differs is an error.

Scale: counting combines on the map side, so a line of all documents sends one row a task. Lines with over a thousandth
of all occurrences, of which there can be a thousand at most, stand in several shards, and their probes are dealt over
those. A shard has a bounded number of keys and probes. Texts are shuffled once, to meet the answers, which are hash-joined.

A null or empty text is one empty line. Null ids come last and count as one document, as do rows that share an id: each
row keeps the lines that are its document's. Answers for rows with null ids go by a hash of the text, so that none is a
list of all such rows' lines. Columns of the input stay, but for those named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import NULL_ID, SHARE, WHITE, as_row, order_id, replace_columns, width, written
from quarrylight.llm.minimal_hash import MinimalHash

KEYS, PROBES = 250_000, 500_000
_WHITE = WHITE.encode()
_MASK = 2**64 - 1


def line_hashes(lines: list[str], min_chars: int) -> list[int]:
    """The 128-bit hash of each line's key, -1 for keys that are too short."""
    out = []
    for line in lines:
        key = line.strip(WHITE)
        out.append(xxhash.xxh3_128_intdigest(key.encode().lower()) if len(key) >= min_chars else -1)
    return out


def _halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([h >> 64 for h in hashes], np.uint64).view(np.int64), np.array([h & _MASK for h in hashes], np.uint64).view(np.int64)


def distinct_lines(df: DataFrame, min_chars: int) -> DataFrame:
    """df (id, text, key) to (h1, h2, id, key), one row for each distinct key of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = set(line_hashes((text or "").split("\n"), min_chars))
                own.discard(-1)
                hashes += own
                owners += [i] * len(own)
            h1, h2 = _halves(hashes)
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(at), batch.column(2).take(at)], names=["h1", "h2", "id", "key"])

    return df.mapInArrow(run, "h1 long, h2 long, id long, key long")


def _prints(h2: np.ndarray) -> np.ndarray:
    return h2.view(np.uint64).astype(np.uint32)


def build_shards(keys: DataFrame) -> DataFrame:
    """keys (shard, h1, h2, n, first) to one row a shard: the levels of its hash, and the arrays by slot."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2, n, first = (table.column(c).combine_chunks().to_numpy() for c in ("h1", "h2", "n", "first"))
        index = MinimalHash.of(h1.view(np.uint64), h2.view(np.uint64))
        order = np.argsort(index.slots(h1.view(np.uint64), h2.view(np.uint64)))
        row = [table.column("shard")[0].as_py(), index.to_bytes(), _prints(h2[order]).tobytes(), np.minimum(n[order], 255).astype(np.uint8).tobytes(), first[order].tobytes()]
        return pa.table({"shard": pa.array(row[:1], pa.int32()), "levels": pa.array([row[1]], pa.list_(pa.binary())), **{k: pa.array([v], pa.binary()) for k, v in zip(("prints", "counts", "firsts"), row[2:], strict=True)}})

    return keys.groupBy("shard").applyInArrow(build, "shard int, levels array<binary>, prints binary, counts binary, firsts binary")


def probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """Probes (h1, h2, id, key) against one shard: the documents with the hashes that they must drop."""
    h1, h2, ids, keys = (left.column(c).combine_chunks().to_numpy() for c in ("h1", "h2", "id", "key"))
    drop = np.zeros(len(left), bool)
    if len(left):
        shard = right.to_pylist()[0]
        index = MinimalHash.from_bytes(shard["levels"])
        prints, counts, firsts = (np.frombuffer(shard[k], t) for k, t in (("prints", np.uint32), ("counts", np.uint8), ("firsts", np.int64)))
        slots = index.slots(h1.view(np.uint64), h2.view(np.uint64))
        if (slots < 0).any() or (prints[slots] != _prints(h2)).any():
            raise ValueError("a line is not in the index")
        drop = (counts[slots] >= 2) & (firsts[slots] < ids)
    return pa.table({"id": ids[drop], "key": keys[drop], "h1": h1[drop], "h2": h2[drop]})


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """df with the lines that stay as its text, and n_lines (before dropping) and n_dropped."""
    spark = df.sparkSession
    id_, value = order_id(f"`{doc_id}`"), F.col(f"`{text}`")
    key = F.when(id_ == NULL_ID, F.xxhash64(value)).otherwise(id_).alias("key")
    lines = written(distinct_lines(df.select(id_.alias("id"), value.alias("text"), key), min_chars), "line-hashes")
    # Rows that share an id are one document.
    held = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    index = written(held.select("h1", "h2", "first", "n", F.when(F.col("first") < F.col("last"), F.col("n")).otherwise(F.lit(1)).alias("documents")), "line-index")
    size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(4 * width(spark), -(-size[0] // KEYS), -(-size[1] // PROBES))
    # At most SHARE lines can each have more than a SHARE-th of the occurrences, which bounds what is broadcast.
    hot = F.broadcast(index.where(F.col("n") * SHARE > size[1]).select("h1", "h2", F.ceil(F.col("n") * SHARE / F.lit(max(1, size[1]))).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))

    def shard(salt):
        return F.pmod(F.xxhash64("h1", salt), F.lit(shards)).cast("int").alias("shard")

    spread = index.join(hot, ["h1", "h2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    entries = spread.select(shard(F.col("salt")), "h1", "h2", F.col("documents").alias("n"), "first")
    # Copies of a hot line may meet in a shard.
    built = written(build_shards(entries.dropDuplicates(["shard", "h1", "h2"])), "line-shards")
    probes = lines.join(hot, ["h1", "h2"], "left").select(shard(F.pmod(F.xxhash64("id", "key"), copies).cast("int")), "h1", "h2", "id", "key")
    answers = probes.groupBy("shard").cogroup(built.groupBy("shard")).applyInArrow(probe, "id long, key long, h1 long, h2 long")
    drops = answers.groupBy("id", "key").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    rows = df.select(as_row(df), id_.alias("id"), value.alias("text"), key)
    # The text goes along once, outside the row.
    others = [c for c in df.columns if c != text]
    rows = rows.select(F.struct(*[F.col(f"__row.`{c}`").alias(c) for c in others]).alias("__row"), "id", "text", "key")
    met = rows.join(drops.hint("shuffle_hash"), ["id", "key"], "left").select("__row", "text", "drops")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, dropped = [], [], []
            for value, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                all_lines = (value or "").split("\n")
                stay = all_lines
                if gone:
                    out = {((d["h1"] & _MASK) << 64) | (d["h2"] & _MASK) for d in gone}
                    stay = [line for line, h in zip(all_lines, line_hashes(all_lines, min_chars), strict=True) if h not in out]
                texts.append("\n".join(stay))
                before.append(len(all_lines))
                dropped.append(len(all_lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=["__row", "text", "n_lines", "n_dropped"])

    schema = met.select("__row", "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    done = met.mapInArrow(keep, schema)
    out = replace_columns(done, "__row", {text: F.col("text"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})
    new = ["n_lines", "n_dropped"]
    return out.select(*[f"`{c}`" for c in df.columns if c.lower() not in new], *new)
