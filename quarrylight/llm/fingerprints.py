"""Document fingerprints: MinHash by universal hash permutations over word shingles, in vectorised numpy.

Each of 128 functions ``(a * x + b mod 2**64) >> 32`` with random 64-bit a and b, a strongly universal family on 32-bit x,
gives the smallest value over a document's shingles. The fingerprint is the low 16 bits of the minima in hexadecimal; the
likeness of two fingerprints is the share of equal places and estimates the Jaccard similarity of the shingle sets.
Bands of the signatures are joined in Spark and the Jaccard similarity of the sets is verified, by ``near_duplicates`` for
texts alone and by ``fingerprint_classes`` for the signatures that its fingerprints are made from.

``with_neighbour`` gives each document the one that follows by id. Documents are dealt into ranges of ids by sampled
quantiles, each range is sorted and streamed, and the first document of a range is also sent to the range before it
(of the first range, to the last), so a text is shuffled once and nothing is sorted in one task. Texts are shuffled
compressed by zstd, unless an id is repeated: rows with equal ids are sorted by their texts. Fingerprints are bytes until
they are returned.

The text and the edited one begin alike. What they share, up to the last white space before the quarter that is replaced, is
split into words and goes through the functions once.

A text without words has the fingerprint of the empty set, which is like only itself (1.0). Null counts as empty. Null
ids come last. Rows with equal ids follow each other by text, null texts as empty. The document after the last is the
first; a lone document follows itself. Texts without words are one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.bucket_links import classes, text_classes, words_digest
from quarrylight.llm.common import NULL_ID, as_row, join_groups, order_id, replace_columns, width, written
from quarrylight.llm.shingles import WORDS, shingle_hashes, shingles_of, word_hashes

PERMUTATIONS = 128
#: 25 bands of 5: of pairs with similarity 0.8, 1 in 20,000 shares no band.
ROWS = 5
#: Every minimum of the empty set.
EMPTY = np.uint32(2**32 - 1)
_U = np.uint64
_random = np.random.default_rng(20240229)
_A = _random.integers(1, 2**64, PERMUTATIONS, np.uint64) | _U(1)
_B = _random.integers(0, 2**64, PERMUTATIONS, np.uint64)
_BLOCK = 512


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of the 128 functions, as 32-bit numbers; all ones for no shingles."""
    least = np.full(PERMUTATIONS, _U(2**64 - 1))
    x = shingles >> _U(32)
    for at in range(0, len(x), _BLOCK):
        # The shift keeps order, so it can follow the minimum.
        np.minimum(least, (_A[:, None] * x[None, at : at + _BLOCK] + _B[:, None]).min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32)


def low_bytes(values: np.ndarray) -> bytes:
    return (values & 0xFFFF).astype(">u2").tobytes()


def digits(values: np.ndarray) -> str:
    return low_bytes(values).hex()


def likeness(one: str, other: str) -> float:
    a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (one, other))
    return float((a == b).mean())


def fingerprint(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """df with fingerprint. One pass, no shuffle."""
    rows = df.select(as_row(df), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [digits(signature(shingle_hashes(t, words))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["__row", "fingerprint"])

    done = rows.mapInArrow(run, rows.select("__row", F.lit("").alias("fingerprint")).schema)
    return replace_columns(done, "__row", {"fingerprint": F.col("fingerprint")})


def _packed(df: DataFrame, bounds: np.ndarray, packs: bool) -> DataFrame:
    """df (id, text) to id, the id's range, size and text in UTF-8: compressed, size being its bytes before, or plain, and size null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = pa.nulls(len(texts), pa.int32())
            if packs:
                raw = texts.to_pylist()
                sizes = pa.array([len(t) for t in raw], pa.int32())
                texts = pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())
            spans = pa.array(np.searchsorted(bounds, batch.column(0).to_numpy().astype(np.float64), side="right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, sizes, texts], names=["id", "range", "size", "text"])

    return df.mapInArrow(run, "id long, range int, size int, text binary")


def in_id_ranges(df: DataFrame) -> DataFrame:
    """df (id, text) as ``_packed``, with guard, sorted by range and guard inside partitions: the rows of each id range, then
    (guard 1) the document that follows its last."""
    spark = df.sparkSession
    n = 4 * width(spark)
    found = df.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)
    bounds = np.unique(np.array(found, np.float64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.float64), side="right").astype(np.int32))

    # As many rows as ranges, which are four times the shuffle partitions.
    of_range = F.min("id").alias("id"), F.count("id").alias("n"), F.count_distinct("id").alias("ids")
    firsts = sorted(df.select("id", range_of("id").alias("range")).groupBy("range").agg(*of_range).collect())
    before = [(row["id"], firsts[i - 1]["range"]) for i, row in enumerate(firsts)]
    guards = F.broadcast(spark.createDataFrame(before, "id long, before int"))
    places = F.array(F.struct("range", F.lit(0).alias("guard")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guard")))
    packed = _packed(df, bounds, all(row["n"] == row["ids"] for row in firsts))
    dealt = packed.join(guards, "id", "left").withColumn("place", F.explode(F.filter(places, lambda p: p["range"].isNotNull())))
    rows = dealt.select("id", "size", "text", "place.range", "place.guard")
    return rows.repartition(width(spark), "range").sortWithinPartitions("range", "guard", "id", "text")


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}


def with_neighbour(df: DataFrame, schema: str, make: Callable[[int, str, str, dict], tuple]) -> DataFrame:
    """df (id, text) to one row a document, ``make(id, text, next text, memo)``; memo keeps what the call before left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        last, memo, out = None, {}, []
        for batch in batches:
            for doc, size, text, span, guard in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                text = (text if size is None else codec.decompress(text, size, asbytes=True)).decode("utf-8")
                if last is not None and last[2] == span:
                    out.append(make(last[0], last[1], text, memo))
                else:
                    memo.clear()
                # What comes after a range's first guard repeats it.
                last = None if guard else (doc, text, span)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
                out = []

    fields = pa.schema([pa.field(n, _ARROW[t]) for n, t in (c.split() for c in schema.split(","))])
    return in_id_ranges(df).mapInArrow(run, schema)


def _slim(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(order_id(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


@dataclass
class _Signed:
    """A text's words and shingles up to ``cut``, which is behind white space before its last quarter, and the signatures of what
    is there (``kept`` shingles) and of the whole; h1 and h2 tell its sequence of words."""

    cut: int
    head: np.ndarray
    kept: int
    of_head: np.ndarray
    whole: np.ndarray
    h1: int
    h2: int


def _signed(text: str, words: int) -> _Signed:
    end = len(text) - len(text) // 4
    # Neither words nor the lower case of letters reach over a space or a line's end.
    cut = max(text.rfind(" ", 0, end), text.rfind("\n", 0, end)) + 1
    head = word_hashes(text[:cut])
    hashed = np.concatenate((head, word_hashes(text[cut:])))
    shingles, kept = shingles_of(hashed, words), max(0, len(head) - words + 1)
    of_head = signature(shingles[:kept])
    return _Signed(cut, head, kept, of_head, np.minimum(of_head, signature(shingles[kept:])), *words_digest(hashed))


def _resigned(signed: _Signed, edited: str, words: int) -> np.ndarray:
    """The signature of a text that is as the signed one up to ``cut``."""
    shingles = shingles_of(np.concatenate((signed.head, word_hashes(edited[signed.cut :]))), words)
    return np.minimum(signed.of_head, signature(shingles[signed.kept :]))


def _edited(docs: DataFrame, words: int) -> DataFrame:
    """docs (id, text) to id, what ``edited_fingerprints`` returns, with digests as bytes, h1 and h2 (of the sequence of words), and bands."""

    def make(doc: int, own: str, following: str, memo: dict) -> tuple:
        mine = memo.pop("next", None) or _signed(own, words)
        memo["next"] = after = _signed(following, words)
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + following[:quarter]
        least, other = mine.whole, _resigned(mine, edited, words) if edited != own else mine.whole
        alike = lambda one: float(((one & 0xFFFF) == (least & 0xFFFF)).mean())
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
        return doc, len(own), digest, low_bytes(least), low_bytes(other), alike(other), alike(after.whole), mine.h1, mine.h2, bands_of(least)

    schema = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, h1 long, h2 long, bands array<long>"
    return with_neighbour(docs, schema, make)


def _shown(doc_id: str) -> list[Column]:
    """The columns of ``edited_fingerprints``."""
    digests = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return [F.nullif("id", F.lit(NULL_ID)).alias(doc_id), F.col("n_chars"), *digests, F.col("near_edited"), F.col("near_next")]


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Edited
    is the text with its last quarter replaced by as much of the beginning of the next document."""
    return _edited(_slim(df, doc_id, text), words).select(*_shown(doc_id))


def fingerprint_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = WORDS) -> DataFrame:
    """``edited_fingerprints`` with class_id and class_size of ``near_duplicates``, from one signature of each text."""
    docs = _slim(df, doc_id, text)
    made = written(_edited(docs, words), "fingerprints")
    copies, _, found = text_classes(made.select("id", "h1", "h2", "bands"), docs, np.unique, threshold, words)
    # Fingerprints are shuffled once, by their words.
    texts = written(copies.join(found.drop("n"), "node").drop("node"), "word-classes")
    every = join_groups(made.drop("bands"), texts, ["h1", "h2"], "n")
    return every.select(*_shown(doc_id), F.nullif("class_id", F.lit(NULL_ID)).alias("class_id"), "class_size")


def bands_of(least: np.ndarray) -> list[int]:
    """The bands of a signature; none of a text without words."""
    if (least == EMPTY).all():
        return []
    return [xxhash.xxh3_64_intdigest(band.tobytes(), i) - 2**63 for i, band in enumerate(least[: PERMUTATIONS // ROWS * ROWS].reshape(-1, ROWS))]


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = WORDS) -> DataFrame:
    """doc_id with class_id and class_size: documents linked by a verified Jaccard similarity of their shingle sets."""
    return classes(df, doc_id, text, lambda shingles: bands_of(signature(shingles)), np.unique, threshold, words)
