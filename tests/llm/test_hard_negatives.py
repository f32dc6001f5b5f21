"""Hard negatives against brute force: blocks of any size, ties, repeated rows, odd vectors."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import common, hard_negatives
from quarrylight.llm import queries as q
from quarrylight.llm.common import prepare
from quarrylight.llm.hard_negatives import mine_hard_negatives, product

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5):
    valid = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((i, [max(-(2**25), min(2**25, math.floor(256 * float(np.float32(x))))) for x in v], label))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (i, v, label) in enumerate(valid):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m == label) for n, (j, w, m) in enumerate(valid) if n != k]
        for p, j, _ in sorted([s for s in scored if s[2]], key=key)[:positives]:
            window = sorted([s for s in scored if not s[2] and 80 * p <= 100 * s[0] <= 100 * p], key=key)[:negatives]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(window, 1)]
    return sorted(out, key=str)


def mined(df, **more):
    rows = mine_hard_negatives(df, F.col("id") % 100 == 0, **more)
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, rows.collect()), key=str)


def test_op11(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    moved = [(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m in rows]
    found = sorted(map(tuple, q.op11_hard_negatives(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found and found == brute(moved)


@pytest.fixture
def vectors():
    r = random.Random(3)
    base = [[r.gauss(0.2, 1) for _ in range(7)] for _ in range(12)]
    out = [(i * 10, [x + r.gauss(0, 0.2) for x in base[i % 12]], i % 3) for i in range(150)]
    # Repeated rows, an anchor among them; equal scores under many ids; a hot vector.
    out += [out[20], out[20], out[31]] + [(5000 + i, base[0], i % 2) for i in range(60)]
    return out


@pytest.mark.parametrize("sizes", [(256, 1024, 32), (3, 7, 2), (1, 500, 7)])
def test_blocks_and_chunks_of_any_size(spark, vectors, monkeypatch, sizes):
    for name, size in zip(("ANCHORS", "ROWS", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    assert mined(spark.createDataFrame(vectors, SCHEMA)) == brute(vectors)
    assert mined(spark.createDataFrame(vectors, SCHEMA), positives=2, negatives=9) == brute(vectors, 2, 9)


def test_odd_rows(spark, vectors, clashing):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None, 1), (100, [1.0, None], 1), (200, [nan] * 7, 1), (300, [inf] * 7, 1), (400, [1.0] * 7, None), (None, [1.0] * 7, 1), (None, [1.0] * 7, 2), (600, [], 1), (700, [2.0, 3.0], 0), (800, [1e30, -1e30] + [0.5] * 5, 2), (900, [0.0] * 9, 1), (-100, [1.0] * 7, 0)]
    rows = vectors + odd
    prepare(spark)
    assert mined(clashing(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []


def test_products_are_exact_at_any_size():
    r = np.random.default_rng(1)
    for most in (100, 2**25):
        a, b = r.integers(-most, most, (5, 32)), r.integers(-most, most, (9, 32))
        assert (product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a])).all()


def test_no_scores_of_pairs_are_written_or_shuffled(spark, tmp_path):
    """What goes to disk grows with the rows, not with anchors times rows."""
    r = random.Random(5)
    sizes = []
    for n in (1000, 4000):
        rows = [(i, [r.random() for _ in range(8)], i % 5) for i in range(n)]
        since = len(common._scratched)
        mined(spark.createDataFrame(rows, SCHEMA).coalesce(2))
        sizes.append(sum(os.path.getsize(os.path.join(at, f)) for path in common._scratched[since:] for at, _, files in os.walk(path) for f in files if f.endswith(".parquet")))
    assert sizes[1] < 5 * sizes[0]
