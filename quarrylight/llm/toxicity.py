"""Toxicity: texts are restored by a noisy-channel decoder, then scored by a classifier over the restored words.

Restoring. A word in disguise is a lattice: a sign may stand for a letter (``1d10t``, ``tr@sh``, ``st*pid``), for a break, or for nothing
(``m.o.r.o.n``); a letter written three times or more stands for one or two; single characters in a row may be one word
(``s c u m``). Viterbi search finds the likeliest reading under a character language model, whose states are the last three
characters of the word, and the channel's costs. A word of letters alone has one reading and is taken as it is, so only
words in disguise are searched. Compatibility forms (full-width, mathematical letters) are folded and invisible characters dropped.

The language model is of four characters in SYMBOLS classes, smoothed by Witten and Bell, from counts over all texts of the
corpus: each task counts its texts, the counts of a task's distinct sequences are shuffled and added. The model has SYMBOLS^4
entries (10 MB), whatever the corpus.

Scoring. A text is the set of its restored words, their beginnings and ends. Learned from the labelled rows that are not held
out: of each label the ``sample`` (2500) documents with the smallest hash of their id. Features that stand out in label 1 (at
most FEATURES) are weighed by a logistic regression, in which the classes count as often as they are among all labelled
rows. Learning is deterministic; on the driver are the language model, at most 2 * sample short lists and the weights. Scoring is one pass
without a shuffle.

Null and empty texts have no words; their score is the model's bias. Labels without a document or a value are passed over,
of several labels of a document the smallest counts, of several texts of a labelled id the smallest. Without labels of both kinds
every score is the share of label 1 (0.5 without labels). A null id is held out. Repeated rows are scored alike. Columns
of the input stay, but for those named like a result column.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import as_row, replace_columns

SAMPLE, FEATURES, THRESHOLD = 2500, 4096, 0.3
#: Classes of characters: the end of a word, a to z, and what other letters share.
SYMBOLS = 40
#: Letters that a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "€": "e", "£": "l", "¥": "y", "¢": "c", "§": "s", "*": "aeiou", "#": "aeiouh", "%": "aeiou", "&": "aeiou",
}
#: Letters of other scripts that look like Latin ones (fixed values).
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k"}
#: Log probabilities of the channel: a sign for a letter, a sign for nothing, a sign for itself (a break), a repeated letter.
SIGN, NOTHING, BREAK, REPEAT = -1.5, -1.5, -1.0, -0.5
_OPENING, _CLOSING = "\"'([{<«»“”„‘’¿¡-–—", "\"')]}>«»“”‘’.,;:!?…-–—"
_THRICE = re.compile(r"(.)\1\1", re.DOTALL)
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACED = 3
#: Distinct words that a worker remembers, and the longest of them.
MEMORY, LONGEST = 200_000, 64


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + zlib.crc32(c.encode("utf-8", "surrogatepass")) % (SYMBOLS - 27) if c.isalpha() else 0


@functools.cache
def _symbols() -> np.ndarray:
    return np.array([_symbol(chr(c)) for c in range(0x10000)], np.uint8)


def folded(text: str) -> str:
    """Lower case, without compatibility forms and invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).lower()


def sequences(texts: list[str]) -> np.ndarray:
    """The number of each sequence of four classes in the texts' words: three before, 0 before a word's begin, and the one they lead to."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[np.minimum(codes, 0xFFFF)].astype(np.int64)
    again = np.zeros(len(s), bool)
    again[1:] = (s[1:] == 0) & (s[:-1] == 0)
    again[2:] |= (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
    s = np.concatenate(([0, 0], s[~again]))
    a, b, c, d = s[:-3], s[1:-2], s[2:-1], s[3:]
    before = np.where(c == 0, 0, np.where(b == 0, c, np.where(a == 0, b * SYMBOLS + c, (a * SYMBOLS + b) * SYMBOLS + c)))
    return (before * SYMBOLS + d)[(c > 0) | (d > 0)]


def language_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """The counts of all sequences over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            texts, size = [], 0
            for value in batch.column(0):
                texts.append(folded(value.as_py()))
                size += len(texts[-1])
                if size > 1 << 20:
                    counts += np.bincount(sequences(texts), minlength=len(counts))
                    texts, size = [], 0
            if texts:
                counts += np.bincount(sequences(texts), minlength=len(counts))
        seen = np.flatnonzero(counts)
        for at in range(0, len(seen), 1 << 16):
            some = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["sequence", "n"])

    there = df.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    added = there.mapInArrow(run, "sequence int, n long").groupBy("sequence").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**4, np.int64)
    counts[added.column("sequence").to_numpy()] = added.column("n").to_numpy()
    return counts


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after three, each order leaning on the next lower one by its number of distinct continuations."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        c = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(0).astype(np.float64)
        kinds = np.maximum((c > 0).sum(-1, keepdims=True), 1)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order > 1 else 1, 1)) if order else p[None]
        p = (c + kinds * lower) / (c.sum(-1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32).ravel()


class Decoder:
    """Readings of words in disguise under a language model."""

    def __init__(self, language: np.ndarray):
        self.language = memoryview(np.ascontiguousarray(language, np.float32))
        self.symbols: dict[str, int] = {}

    def options(self, c: str, n: int, latin: bool) -> list[tuple[str, float]]:
        """What n times the character c may stand for."""
        if c == " ":
            return [(" ", 0.0), ("", NOTHING)]
        if c.isalpha():
            out = [(c, 0.0)] if n == 1 else [(c, REPEAT), (c + c, 0.0 if n == 2 else REPEAT)]
            if latin and c in ALIKE:
                out += [(ALIKE[c] * len(s), SIGN / 2 + p) for s, p in out]
            return out
        letters = LEET.get(c, "")
        out = [(" ", BREAK), ("", NOTHING), *((x, SIGN) for x in letters)]
        return out + [(x + x, SIGN) for x in letters if n > 1]

    def read(self, span: str) -> tuple[str, ...]:
        """The words of the likeliest reading."""
        language, symbols, size = self.language, self.symbols, SYMBOLS
        latin = any("a" <= c <= "z" for c in span)
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        at = 0
        while at < len(span):
            c, end = span[at], at + 1
            while end < len(span) and span[end] == c:
                end += 1
            found: dict[int, tuple[float, tuple | None]] = {}
            for letters, cost in self.options(c, end - at, latin):
                for state, (score, way) in states.items():
                    now, then = score + cost, state
                    for x in letters:
                        if x == " ":
                            if then:
                                now += language[then * size]
                                then = 0
                        else:
                            k = symbols.get(x)
                            if k is None:
                                k = symbols[x] = _symbol(x)
                            now += language[then * size + k]
                            then = then % (size * size) * size + k
                    best = found.get(then)
                    if best is None or now > best[0]:
                        found[then] = now, (way, letters) if letters else way
            states = found
            at = end
        _, way = max((score + (language[state * size] if state else 0.0), way or ()) for state, (score, way) in states.items())
        out = []
        while way:
            way, letters = way
            out.append(letters)
        return tuple("".join(reversed(out)).split())


def plain(token: str) -> str | None:
    """The word that the token is, if it has one reading."""
    core = token.lstrip(_OPENING).rstrip(_CLOSING)
    if not core or (core.isalpha() and not _THRICE.search(core) and (core.isascii() or not any(c in ALIKE for c in core) or not any("a" <= c <= "z" for c in core))):
        return core
    return None


class Reader:
    """Texts to values of their restored words, remembered by word: ``value`` makes one of the words of a reading."""

    def __init__(self, decoder: Decoder, value):
        self.decoder, self.value, self.known = decoder, value, {}

    def _value(self, span: str, words: tuple[str, ...] | None, shown: str):
        hit = words is None
        if hit:
            words = self.decoder.read(span)
        found = self.value(words, shown), hit
        if len(shown) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[shown] = found
        return found

    def token(self, token: str):
        """(value, whether it was read from a lattice)."""
        found = self.known.get(token)
        if found is None:
            core = plain(token)
            if core is None:
                found = self._value(token.lstrip(_OPENING).rstrip(_CLOSING), None, token)
            else:
                found = self._value(core, (core,) if core else (), token)
        return found

    def values(self, text: str) -> Iterator[tuple]:
        """A value for each word, or row of single characters, of the whole text."""
        known, single = self.known, []
        for token in folded(text).split():
            if len(token) == 1 and (token.isalpha() or token in LEET and token not in "|&+#*%"):
                single.append(token)
                continue
            if single:
                yield from self._singles(single)
                single = []
            yield known.get(token) or self.token(token)
        if single:
            yield from self._singles(single)

    def _singles(self, single: list[str]) -> Iterator[tuple]:
        if len(single) < _SPACED:
            for token in single:
                yield self.known.get(token) or self.token(token)
        else:
            span = " ".join(single)
            yield self.known.get(span) or self._value(span, None, span)


def restore(df: DataFrame, language: np.ndarray, text: str = "text") -> DataFrame:
    """df with restored: the text's words (lower case, single spaces), those in disguise as they are read; null for null."""
    rows = df.select(as_row(df), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Decoder(shared.value), lambda words, shown: " ".join(words))
        for batch in batches:
            out = [None if t is None else " ".join(v for v, _ in reader.values(t) if v) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["__row", "restored"])

    done = rows.mapInArrow(run, rows.select("__row", F.lit(None).cast("string").alias("restored")).schema)
    return replace_columns(done, "__row", {"restored": F.col("restored")})


def word_features(word: str) -> list[int]:
    """The word, its beginnings of 3 to 6 characters and ends of 3 to 5, as numbers."""
    kinds = ["=" + word, *("^" + word[:n] for n in range(3, 7) if n <= len(word)), *("$" + word[-n:] for n in range(3, 6) if n <= len(word))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in kinds]


class ToxicityModel:
    """Language model, weights of features and bias."""

    def __init__(self, language: np.ndarray, weights: dict[int, float] | None = None, bias: float = 0.0):
        self.language, self.weights, self.bias = language, weights or {}, bias

    def reader(self) -> Reader:
        weights = self.weights
        return Reader(Decoder(self.language), lambda words, shown: tuple({f for w in words for f in word_features(w) if f in weights}))

    def score(self, reader: Reader, text: str | None) -> tuple[float, int]:
        """The score, and the number of words read from lattices."""
        seen: set[int] = set()
        disguised = 0
        for features, hit in reader.values(text or ""):
            if features:
                seen.update(features)
            disguised += hit
        x = self.bias + sum(self.weights[f] for f in sorted(seen))
        return 1 / (1 + float(np.exp(-np.clip(x, -30, 30)))), disguised


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def logistic(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, width: int, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias over sets of features (numbers below width), by Adam on all rows."""
    at = np.concatenate([np.full(len(d), i) for i, d in enumerate(docs)]) if docs else np.zeros(0, np.int64)
    feature = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    at, feature = at.astype(np.int64), feature.astype(np.int64)
    share = weight / weight.sum()
    p = np.zeros(width + 1)
    mean = float((share * y).sum())
    p[-1] = np.log(mean / (1 - mean))
    m, s = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        x = p[-1] + np.bincount(at, weights=p[feature], minlength=len(y))
        g = share * (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y)
        d = np.append(np.bincount(feature, weights=g[at], minlength=width) + decay * p[:-1], g.sum())
        m, s = 0.9 * m + 0.1 * d, 0.999 * s + 0.001 * d * d
        p -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[:-1], float(p[-1])


def fit_toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Learns the language from all texts of df, the weights from labels (doc_id, toxic) of documents of df that are not held out."""
    spark = df.sparkSession
    language = smoothed(language_counts(df, text))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.min("toxic").cast("int").alias("toxic"))
    texts = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    there = known.join(texts.select("id").distinct(), "id", "left_semi")
    total = dict(there.where("toxic in (0, 1)").groupBy("toxic").count().collect())
    if len(total) < 2:
        share = float(np.clip(total.get(1, 0) / sum(total.values()) if total else 0.5, 1e-6, 1 - 1e-6))
        return ToxicityModel(language, {}, float(np.log(share / (1 - share))))
    # At most ``sample`` rows of each label are broadcast.
    first = lambda label: there.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = texts.join(F.broadcast(first(0).unionByName(first(1))), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    shared = spark.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Decoder(shared.value), lambda words, shown: tuple({f for w in words for f in word_features(w)}))
        for batch in batches:
            sets = [np.array(sorted({f for v, _ in reader.values(t or "") for f in v}), np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("toxic"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "toxic", "features"])

    rows = chosen.mapInArrow(run, "id long, toxic int, features array<long>").persist()
    n = dict(rows.groupBy("toxic").count().collect())
    each = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1"))
    # Standard scores of the difference of two shares.
    p0, p1, p = F.col("n0") / n[0], F.col("n1") / n[1], (F.col("n0") + F.col("n1") + 1) / (n[0] + n[1])
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    telling = each.withColumn("z", z).where((F.col("z") > 3.5) & (F.col("n1") >= 3)).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature")
    names = np.sort(telling.toArrow().column(0).to_numpy())
    numbered = spark.sparkContext.broadcast(names)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for f in batch.column("features"):
                own = np.asarray(f.values)
                kept.append(np.flatnonzero(np.isin(numbered.value, own, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(kept, pa.list_(pa.int64()))], names=["id", "toxic", "features"])

    found = rows.mapInArrow(picked, "id long, toxic int, features array<long>").toArrow().sort_by("id")
    rows.unpersist()
    y = found.column("toxic").to_numpy().astype(np.float64)
    weight = np.array([total[int(v)] / n[int(v)] for v in y])
    weights, bias = logistic([np.asarray(f.values, np.int64) for f in found.column("features")], y, weight, len(names))
    return ToxicityModel(language, {int(f): round(float(w), 9) for f, w in zip(names, weights, strict=True)}, round(bias, 9))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score, predicted and n_disguised (words, or rows of single characters, that were read from lattices)."""
    rows = df.select(as_row(df), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = model.reader()
        for batch in batches:
            scored = [model.score(reader, t.as_py()) for t in batch.column(1)]
            scores, disguised = zip(*scored, strict=True) if scored else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(disguised, pa.int64())], names=["__row", "score", "n_disguised"])

    done = rows.mapInArrow(run, rows.select("__row", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_disguised")).schema)
    return replace_columns(done, "__row", {"score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int"), "n_disguised": F.col("n_disguised")})
