"""Models that run inside tasks: batched encoding and scoring, and word vectors that are learned from the corpus.

A model is loaded once a Python worker. Texts go through it in groups of like lengths, so that short texts don't wait for
long ones and a group holds a bounded number of characters (one longer text is a group of its own). What a model returns is
checked: a row for each text, the stated dimension, finite numbers.

The model that comes with the engine is learned by random indexing: a word's index vector has a one or minus one at a
place told by its hash; a chunk's context is the sum over its distinct words; a word's vector is the sum of the contexts
of its chunks. All are whole numbers, so the result doesn't depend on the order of rows. Tasks add up the vectors of their
batches, one shuffle of combined sums adds the tasks'.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from quarrylight.functions.text import index_tokens

#: Bytes that a model may broadcast.
MODEL_BYTES = 256 << 20
#: Characters in a group of texts, and rows in a batch.
GROUP_CHARS = 1 << 18
BATCH_ROWS = 256
#: Words that a task adds up before it hands them on.
HELD_WORDS = 50_000
#: Bytes of an Arrow batch of words, which are several times as large as Python strings.
BATCH_BYTES = "4m"


def length_groups(lengths: list[int], most: int = GROUP_CHARS) -> Iterator[list[int]]:
    """Places in groups of like lengths, shortest first; the longest of a group times its size is ``most`` at most."""
    group: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if group and (len(group) + 1) * max(1, lengths[i]) > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def checked_output(out: object, rows: int, shape: tuple[int, ...]) -> np.ndarray:
    """A model's output as floats of ``rows`` rows of ``shape``; ValueError if it is something else."""
    found = np.asarray(out, np.float64)
    if found.ndim == 0 or len(found) != rows:
        raise ValueError(f"the model returned {found.shape[0] if found.ndim else 'no'} rows for {rows} texts")
    if found.shape[1:] != shape:
        raise ValueError(f"the model returned rows of shape {found.shape[1:]}, not {shape}")
    if not np.isfinite(found).all():
        raise ValueError("the model returned numbers that are not finite")
    return found


def _grouped(model: Callable, columns: tuple, shape: tuple[int, ...]) -> np.ndarray:
    texts = [["" if x is None else x for x in c] for c in columns]
    out = np.zeros((len(texts[0]), *shape))
    for group in length_groups([sum(map(len, row)) for row in zip(*texts, strict=True)]):
        out[group] = checked_output(model(*[[c[i] for i in group] for c in texts]), len(group), shape)
    return out


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int) -> Callable[[Column], Column]:
    """A column function text -> array<float> of a model that ``load`` makes: texts to an array of (texts, dimension).
    Null is null."""

    def make() -> Callable:
        model = load()
        return lambda texts: _grouped(model, (texts,), (dimension,)).astype(np.float32)

    run = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=BATCH_ROWS)
    return lambda text: F.when(text.isNotNull(), run(F.coalesce(text, F.lit(""))))


def scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A column function (query, text) -> double of a model that ``load`` makes. Null if either is null."""

    def make() -> Callable:
        model = load()
        return lambda queries, texts: _grouped(model, (queries, texts), ())

    run = predict_batch_udf(make, return_type=DoubleType(), batch_size=BATCH_ROWS)
    return lambda query, text: F.when(query.isNotNull() & text.isNotNull(), run(F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))))


def index_place(word: str, dimension: int) -> tuple[int, int]:
    """The place and the sign of a word's index vector."""
    h = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)
    return (h >> 1) % dimension, 1 if h & 1 else -1


def word_vectors(chunks: DataFrame, text: str = "text", dimension: int = 64) -> DataFrame:
    """word, df (chunks that hold it), vector (array<long>). Null texts hold no words."""
    chunks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    rows = chunks.select(F.array_distinct(index_tokens(F.col(f"`{text}`"))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        places: dict[str, tuple[int, int]] = {}

        def take() -> pa.RecordBatch:
            sums = np.stack(list(held.values()))
            columns = [pa.array(list(held), pa.string()), *[pa.array(sums[:, i]) for i in range(dimension + 1)]]
            held.clear()
            places.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "df", *names])

        for batch in batches:
            # One text's words at a time: a batch holds many.
            for words in (row.as_py() for row in batch.column(0)):
                context = np.zeros(dimension + 1, np.int64)
                context[0] = 1
                for w in words or ():
                    if w not in places:
                        places[w] = index_place(w, dimension)
                    place, sign = places[w]
                    context[place + 1] += sign
                for w in words or ():
                    if w in held:
                        held[w] += context
                    else:
                        held[w] = context.copy()
                if len(held) > HELD_WORDS:
                    yield take()
        if held:
            yield take()

    names = [f"v{i}" for i in range(dimension)]
    partial = rows.mapInArrow(run, "word string, df long, " + ", ".join(f"{n} long" for n in names))
    summed = partial.groupBy("word").agg(F.sum("df").alias("df"), *[F.sum(n).alias(n) for n in names])
    return summed.select("word", "df", F.array(*names).alias("vector"))


class WordModel:
    """Words with unit vectors and weights. A text is the unit sum of its known distinct words; a query's score of a text is the
    weighted mean, over the query's known words, of the likeness to the nearest word of the text."""

    def __init__(self, words: list[str], vectors: np.ndarray, weights: np.ndarray):
        self.places = {w: i for i, w in enumerate(words)}
        self.vectors, self.weights = vectors, weights

    def known(self, words: list[str]) -> list[int]:
        return [self.places[w] for w in dict.fromkeys(words) if w in self.places]

    def encode(self, texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for i, words in enumerate(texts):
            at = self.known(words)
            out[i] = self.weights[at] @ self.vectors[at]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def score(self, queries: list[list[str]], texts: list[list[str]]) -> np.ndarray:
        out = np.zeros(len(queries))
        for i, (q, t) in enumerate(zip(queries, texts, strict=True)):
            a, b = self.known(q), self.known(t)
            if a and b:
                out[i] = self.weights[a] @ (self.vectors[a] @ self.vectors[b].T).max(axis=1) / self.weights[a].sum()
        return out


def train(chunks: DataFrame, text: str = "text", dimension: int = 64, vocabulary: int = 50_000) -> Broadcast:
    """The broadcast model of the ``vocabulary`` words that the most chunks hold, ties by the word. Statistics are of all chunks; the
    vocabulary bounds what the driver and the tasks hold."""
    if vocabulary * dimension * 8 > MODEL_BYTES:
        raise ValueError(f"{vocabulary} words of {dimension} numbers are over {MODEL_BYTES} bytes")
    best = word_vectors(chunks, text, dimension).orderBy(F.desc("df"), "word").limit(vocabulary).collect()
    n = chunks.count()
    vectors = np.array([r["vector"] for r in best], np.float64).reshape(len(best), dimension)
    # What all words share tells none apart.
    vectors -= vectors.sum(axis=0) / max(1, len(best)) if len(best) > 1 else 0
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    weights = np.array([math.log(1 + n / r["df"]) for r in best])
    return chunks.sparkSession.sparkContext.broadcast(WordModel([r["word"] for r in best], vectors, weights))


def _joined(text: Column) -> Column:
    return F.array_join(index_tokens(text), " ")


def trained_encoder(model: Broadcast, dimension: int = 64) -> Callable[[Column], Column]:
    """The encoder of a trained model, for ``Engine`` and ``Store``."""
    run = encoder(lambda: lambda texts: model.value.encode([t.split() for t in texts]), dimension)
    return lambda text: run(_joined(text))


def trained_scorer(model: Broadcast) -> Callable[[Column, Column], Column]:
    """The scorer of a trained model, for ``Engine``."""
    run = scorer(lambda: lambda queries, texts: model.value.score([q.split() for q in queries], [t.split() for t in texts]))
    return lambda query, text: run(_joined(query), _joined(text))
