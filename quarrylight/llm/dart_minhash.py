"""MinHash near dedup with DartMinHash signatures over weighted word shingles.

A document is a weighted set: its five-word shingles with their counts. For every shingle, darts are thrown at the plane
of weight and rank: the plane is cut into regions that double in width on either axis, and a hash of shingle and region
says how many darts fall there (Poisson with the region's area as mean) and where. Darts below the shingle's weight hit.
Every dart belongs to one of k coordinates, and the hit with the earliest rank is the coordinate's value. Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity. Ranks are looked at up to a bound at
which about k ln k + 2k darts hit, and, if a coordinate is still without a hit, up to twice that, and so on.

Signatures are cut into bands; bucket_links makes the classes and verifies each link by the exact weighted Jaccard
similarity. With 57 bands of 8, of pairs with similarity 0.8 about 1 in 35,000 shares no band, and of pairs with 0.3
about 1 in 270 shares one, so that passages which many documents share make few candidates.

Null texts count as empty; texts without words are copies of each other. Null ids come last. Columns of the input stay,
but for those named like a result column.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.bucket_links import classes
from quarrylight.llm.common import as_row, order_id, replace_columns, written
from quarrylight.llm.minimal_hash import mix64
from quarrylight.llm.shingles import WORDS, as_set, numbered

BANDS, ROWS = 57, 8
#: Width of the first rank region; the region after it is as wide, then they double.
UNIT = 1 / 2
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _salts(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(_U) + _U(1)) * _U(_STEP)


_turns = mix64(_salts(np.arange(4096)))
_tables: dict[float, np.ndarray] = {}


def _turns_to(n: int) -> np.ndarray:
    global _turns
    if len(_turns) < n:
        _turns = mix64(_salts(np.arange(2 * n)))
    return _turns


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities, to far into the tail."""
    if mean not in _tables:
        top = int(mean + 12 * math.sqrt(mean) + 24)
        logs = np.arange(top + 1) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(top + 1)])
        _tables[mean] = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return _tables[mean]


def _rank_region(p: int) -> tuple[float, float]:
    """Begin and width of a rank region."""
    return (0.0, UNIT) if p == 0 else (UNIT * 2.0 ** (p - 1), UNIT * 2.0 ** (p - 1))


def _thrown(elements: np.ndarray, weights: np.ndarray, v: int, first: int, end: int, light: bool) -> tuple[np.ndarray, np.ndarray]:
    """The darts of weight region v and rank regions first to end that hit: their hashes and ranks. A dart's hash holds its
    rank in the upper 44 bits and its coordinate in the lower 20."""
    low_w, wide_w = 2.0**v - 1, 2.0**v
    ranges = range(first, end + 1)
    region = mix64(elements[None, :] + _salts(np.arange(first, end + 1) + v * 4096)[:, None])
    unit = (region >> _U(11)) * 2.0**-53
    n = np.concatenate([np.searchsorted(_poisson(wide_w * _rank_region(p)[1]), unit[i], side="right") for i, p in enumerate(ranges)])
    own = np.repeat(np.arange(len(n)), n)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix64(region.ravel()[own] ^ _turns_to(int(n.max()) + 1)[turn])
    row = own // len(elements)
    if v or light:
        below = low_w + wide_w * ((mix64(dart + _U(_STEP)) >> _U(11)) * 2.0**-53) < weights[own - row * len(elements)]
        dart, row = dart[below], row[below]
    lows, wides = (np.array(x) for x in zip(*map(_rank_region, ranges), strict=True))
    return dart, lows[row] + wides[row] * ((dart >> _U(20)) * 2.0**-44)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k values of a weighted set: elements are distinct 64-bit hashes, weights are positive."""
    bound = (k * math.log(k) + 2 * k) / float(weights.sum())
    best, value = np.full(k, np.inf), np.zeros(k, _U)
    light, top = bool((weights < 1).any()), float(weights.max())
    first = 0
    while True:
        end = max(first, math.ceil(math.log2(max(bound / UNIT, 1))))
        parts = [_thrown(elements, weights, 0, first, end, light)]
        v = 1
        while top > 2.0**v - 1:
            heavy = weights > 2.0**v - 1
            parts.append(_thrown(elements[heavy], weights[heavy], v, first, end, light))
            v += 1
        dart, rank = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts, strict=True))
        place = ((dart & _U(0xFFFFF)) % _U(k)).astype(np.int64)
        order = np.argsort(-rank)
        # Of several values for one place the last written stays: that of the earliest rank.
        earliest, name = np.full(k, np.inf), np.zeros(k, _U)
        earliest[place[order]], name[place[order]] = rank[order], dart[order]
        better = earliest < best
        best[better], value[better] = earliest[better], name[better]
        # Ranks past the last region can't come before those that were found.
        if np.isfinite(best).all():
            return value
        first = end + 1


def bands_of(shingles: np.ndarray) -> list[int]:
    """The bands of a document's shingles."""
    if not len(shingles):
        return []
    elements, counts = numbered(shingles)
    values = dart_signature(elements, counts.astype(np.float64), BANDS * ROWS).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(band.tobytes(), i) - 2**63 for i, band in enumerate(values)]


def near_duplicate_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and class_size, a row for each row of df."""
    return classes(df, doc_id, text, bands_of, as_set, threshold, words)


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = WORDS) -> DataFrame:
    """One row of df for each class, with class_size. It is the row with the smallest id; of rows with equal or null ids, each
    is classed by its own text, and one with the smallest hash of id and text stays."""
    id_ = order_id(f"`{doc_id}`")
    if df.select(id_.alias("id")).groupBy("id").count().where("count > 1").isEmpty():
        found = near_duplicate_classes(df, doc_id, text, threshold, words)
        first = found.where(F.col(doc_id).eqNullSafe(F.col("class_id"))).select(order_id(f"`{doc_id}`").alias("key"), "class_size")
        rows = df.select(as_row(df), id_.alias("key"))
        return replace_columns(rows.join(first.hint("shuffle_hash"), "key"), "__row", {"class_size": F.col("class_size")})
    # Ids repeat: rows go by a hash of id and text instead, rows equal in both as one.
    rows = df.select(as_row(df), id_.alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(id_, F.col(f"`{text}`")).alias("key"))
    nodes = written(rows.groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("n")), "rows-by-hash")
    found = near_duplicate_classes(nodes.select("key", "text"), "key", "text", threshold, words).select("key", "class_id")
    classed = found.join(nodes.select("key", "id", "n"), "key").groupBy("class_id")
    first = classed.agg(F.min(F.struct("id", "key")).alias("least"), F.sum("n").alias("class_size")).select("least.key", "class_size")
    kept = rows.select("key", "__row").join(first.hint("shuffle_hash"), "key").groupBy("key").agg(F.first("__row").alias("__row"), F.first("class_size").alias("class_size"))
    return replace_columns(kept, "__row", {"class_size": F.col("class_size")})
