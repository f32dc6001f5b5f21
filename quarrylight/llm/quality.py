"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

A text is cut into passages of 64 words. Every passage is encoded: shares of kinds of characters, repetition of words,
and hashed frequencies of trigrams of character shapes; then a learned layer. Gated attention weights, learned from
document labels alone, sum the passages into one representation, from which the score comes. A document that is junk in
one place can so be told by that passage.

Fitting takes a bounded sample: of the labelled documents that are not held out, the ``sample`` (3000) with the smallest
hash of their id, with all their passages: of a text with more than ``bag`` (128) passages, the encodings of neighbours are
averaged, so that as many are left and none is passed over. Scoring takes all passages of all documents as they are.
Inputs are texts alone. Fitting is deterministic. The sample is gathered on the driver (at most sample * bag encodings,
150 MB; some 10 MB for documents of a few hundred words), the model (40 KB) is sent to the tasks; scoring is one pass
without a shuffle.

Null and empty texts have one empty passage. Labels without a document or a quality are passed over, of several labels
of a document the smallest counts. Without labels of both kinds, the score is the share of label 1 (0.5 without labels).
A null id is held out. Columns of the input stay, but for those named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.bpe import pieces
from quarrylight.llm.common import as_row, replace_columns
from quarrylight.llm.minimal_hash import mix64
from quarrylight.llm.shingles import _powers_to

WORDS, SAMPLE, BAG = 64, 3000, 128
#: Passages from which on a task scores what it has encoded.
SCORED = 4096
THRESHOLD = 0.3
STATS, SHAPES = 12, 180
WIDTH, HIDDEN, GATE = STATS + SHAPES, 24, 16
_U = np.uint64


def _shapes() -> np.ndarray:
    """A byte's shape: white space 0, letters, digits and other characters outside ASCII share one each, punctuation is its own."""
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        table[b] = 4 if b >= 128 else 0 if c.isspace() or b < 32 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else b
    table[10] = 5
    return table


_SHAPE = _shapes()


def _encode_piece(raw: np.ndarray, words: int) -> np.ndarray:
    white = (raw <= 32) & ((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = ~white & np.concatenate(([True], white[:-1]))
    n = int(begins.sum())
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    bags = -(-n // words)
    word = np.maximum(np.cumsum(begins) - 1, 0)
    passage = word // words
    size = np.maximum(np.bincount(passage, minlength=bags), 1).astype(np.float64)
    shape = _SHAPE[raw]
    letters = ~white
    starts = np.flatnonzero(begins)
    own = np.repeat(np.arange(n), np.diff(np.append(starts, len(raw))))
    place = np.arange(starts[0], len(raw)) - starts[own]
    inside = letters[starts[0] :]
    hashed = mix64(np.add.reduceat(np.where(inside, raw[starts[0] :].astype(_U) + _U(1), _U(0)) * _powers_to(int(place.max()) + 1)[place], starts - starts[0]))
    of_word = np.arange(n) // words
    count = np.bincount(of_word, minlength=bags).astype(np.float64)
    same = np.concatenate(([False], hashed[1:] == hashed[:-1]))
    distinct = np.unique(hashed ^ mix64(of_word.astype(_U) + _U(7)), return_index=True)[1]

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(passage[mask], minlength=bags)[:bags] / size

    # The last letter before each further word, and before the end.
    before = np.append(starts[1:], len(raw)) - 1
    last = shape[np.maximum.accumulate(np.where(letters, np.arange(len(raw)), 0))][before]
    odd_end = np.bincount(of_word, weights=((last > 5) & (last != 46) & (last != 44)).astype(float), minlength=bags) / count
    stats = np.stack([
        count / words, np.bincount(of_word[distinct], minlength=bags) / count, np.bincount(of_word[same], minlength=bags) / count,
        size / count / 10, share(shape == 2), share(shape == 3), share(shape > 5), share(shape == 5) * 10, share(shape == 4), odd_end,
        np.bincount(of_word, weights=(hashed == hashed[0]), minlength=bags)[:bags] / count, np.ones(bags),
    ], axis=1)
    grams = (shape[:-2] * 16384 + shape[1:-1] * 128 + shape[2:]).astype(_U)
    slot = (mix64(grams) % _U(SHAPES)).astype(np.int64)
    table = np.bincount(passage[: len(slot)] * SHAPES + slot, minlength=bags * SHAPES)[: bags * SHAPES].reshape(bags, SHAPES)
    return np.concatenate([stats, np.sqrt(table / size[:, None])], axis=1).astype(np.float32)


def encode_passages(text: str | None, words: int = WORDS) -> np.ndarray:
    """A row for each passage of the whole text. A long text is read in pieces, which begin a new passage."""
    parts = [_encode_piece(np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8), words) for piece in pieces(text or "", 1 << 20) if piece] if text else []
    return np.concatenate(parts) if parts else np.zeros((1, WIDTH), np.float32)


def pooled(x: np.ndarray, bag: int) -> np.ndarray:
    """No more than ``bag`` rows: means of neighbouring ones, as many in each as can be."""
    if len(x) <= bag:
        return x
    starts = np.arange(bag) * len(x) // bag
    return np.add.reduceat(x, starts) / np.diff(np.append(starts, len(x)))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """score = sigmoid(c . sum_i a_i h_i + d), h = tanh(W x), a = softmax over passages of w . (tanh(V h) * sigmoid(U h))."""

    def __init__(self, prior: float = 0.5, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {
            "W": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.array(np.log(prior / (1 - prior))),
        }

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return x, h, v, u, a, bag, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._forward(x, starts)[-1]

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, v, u, a, bag, z, s = self._forward(x, starts)
        g = (s - y) / len(y)
        dz = g[:, None] * p["c"]
        through = (dz[bag] * h).sum(1)
        de = a * (through - np.add.reduceat(a * through, starts)[bag])
        dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ g, "d": g.sum()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-3) -> AttentionModel:
        everything = np.concatenate(bags)
        self.mean = everything.mean(0, dtype=np.float64)
        self.scale = 1 / np.maximum(everything.std(0, dtype=np.float64), 0.02)
        r = np.random.default_rng(11)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                lengths = np.array([len(bags[i]) for i in some])
                g = self._gradients(np.concatenate([bags[i] for i in some]), np.cumsum(lengths) - lengths, labels[some])
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] * (1 - now * decay * (k in "WVUwc")) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, bag: int = BAG) -> AttentionModel:
    """Learns from labels (doc_id, quality) of documents of df that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    texts = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    there = known.join(texts.select("id").distinct(), "id", "left_semi")
    # At most ``sample`` rows are broadcast.
    chosen = there.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = texts.join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for value in batch.column(1).to_pylist():
                sets.append(pooled(encode_passages(value), bag).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sets, pa.binary())], names=["id", "quality", "x"])

    found = rows.mapInArrow(run, "id long, quality int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    y = found.column("quality").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return AttentionModel(float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)))
    bags = [np.frombuffer(x.as_py(), np.float16).reshape(-1, WIDTH).astype(np.float32) for x in found.column("x")]
    return AttentionModel(float(y.mean())).fit(bags, y)


def score_quality(df: DataFrame, model: AttentionModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score and predicted."""
    rows = df.select(as_row(df), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            bags, n = [], 0
            texts = batch.column(1)
            for i in range(len(texts)):
                bags.append(encode_passages(texts[i].as_py()))
                n += len(bags[-1])
                if n >= SCORED or i == len(texts) - 1:
                    lengths = np.array([len(x) for x in bags])
                    # The last digits depend on what is scored together.
                    scores += np.round(shared.value.score(np.concatenate(bags), np.cumsum(lengths) - lengths), 9).tolist()
                    bags, n = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["__row", "score"])

    done = rows.mapInArrow(run, rows.select("__row", F.lit(0.0).alias("score")).schema)
    return replace_columns(done, "__row", {"score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")})
