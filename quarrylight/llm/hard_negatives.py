"""Hard negatives for contrastive training, by a block matrix product in two dimensions (as SUMMA deals blocks).

Vectors become whole numbers. Anchors are packed in blocks of ANCHORS, all rows in blocks of ROWS. A task of the product meets
some row blocks with some anchor blocks; the tile of a pair of blocks stays where it is and panels of CHUNK dimensions are added
to it. A tile is reduced at once to what its anchors may need of it and is not kept: first each anchor's best rows of its label,
reduced over all tasks to its positives; then, in a second product, as the windows below the positives are known, the best rows of
other labels in each window, again reduced over all tasks. Products run as float64 where their sums are whole numbers below 2^53,
else as int64; both are exact.

Scale: what is written and shuffled are the rows, in blocks, and each task's best rows of each anchor. Rows are read in a fixed
number of tasks a core, so both grow with the table, while the product's time grows with anchors times rows, as every anchor meets
every row. A task holds a batch of pairs of blocks, and the best rows of HELD anchors. Nothing is collected but the number of anchors.

Rows with a null label, a null vector, or a null or non-finite component take no part. Components are held to +-2^25 after
scaling, so that sums stay within int64; missing ones of a shorter vector count as zero. A null id comes after all others.
Repeated rows are rows of their own: as anchors, positives and negatives. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import NULL_ID, order_id, written

ANCHORS, ROWS, CHUNK = 512, 4096, 256
#: Anchors that a task of the product meets, tasks a core that the rows are dealt to, and columns of a tile looked at together.
HELD, TASKS, STRIP = 32_768, 3, 512
#: Components are held to this after scaling: 2^50 a product, 1024 dimensions and a factor of 8 fit an int64.
HELD_TO = 2**25
EXACT = 2**53
LEAST = np.iinfo(np.int64).min
#: about: row, id and label of each row, as int64; v: its components, as int32.
BLOCK = "i long, about binary, v binary"
BEST = "i long, anchor long, score long, id long, row long"
FOUND = "anchor long, anchor_id long, positive_row long, positive_id long, positive_score long, score long, id long, row long"


def whole_vectors(df: DataFrame, id_: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label, v (whole components) of the rows that take part."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(v.isNotNull() & F.col(f"`{label}`").isNotNull()).where(~bad)
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(HELD_TO))), F.lit(-float(HELD_TO)))).cast("int"))
    return rows.select(order_id(f"`{id_}`").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), held.alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times the transposed b, exact, as int64."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _packed(size: int):
    """Rows (row, id, label, v) of a partition to blocks of ``size``, each sorted by id. A block is as wide as its longest vector."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        v = rows.column("v").combine_chunks()
        lengths = pc.list_value_length(v).to_numpy()
        wide = np.zeros((len(lengths), max(1, int(lengths.max()))), np.int32)
        wide[np.arange(wide.shape[1]) < lengths[:, None]] = v.flatten().to_numpy()
        about = np.stack([rows.column(c).to_numpy() for c in ("row", "id", "label")])
        return pa.RecordBatch.from_arrays([pa.array([int(about[0].min())]), pa.array([about.tobytes()], pa.binary()), pa.array([wide.tobytes()], pa.binary())], names=["i", "about", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                rows = pa.Table.from_batches(held)
                for at in range(0, n - n % size, size):
                    yield block(rows.slice(at, size))
                # A copy, as a slice keeps all that it was cut from.
                held, n = rows.slice(n - n % size).take(np.arange(n % size)).to_batches(), n % size
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _block(about: pa.Scalar, v: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(about.as_buffer(), np.int64).reshape(3, -1)
    return own, np.frombuffer(v.as_buffer(), np.int32).reshape(own.shape[1], -1)


def tile_of(a: np.ndarray, b: np.ndarray, chunk: int) -> np.ndarray:
    """The product of two blocks, panels of ``chunk`` dimensions added in place."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, min(a.shape[1], b.shape[1]), chunk):
        out += product(*(side[:, k : min(k + chunk, a.shape[1], b.shape[1])].astype(np.int64) for side in (a, b)))
    return out


class Best:
    """The best ``most`` candidates (score, id, row) of each of some groups."""

    def __init__(self, groups: int, most: int):
        self.most, self.least = most, np.full(groups, LEAST)
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, *found: np.ndarray) -> None:
        """group, score, id, row of candidates that are no lower than ``least`` of their groups."""
        if not len(found[0]):
            return
        group, score, id_, row = (np.concatenate(both) for both in zip(self.rows, found, strict=True))
        order = np.lexsort((row, id_, -score, group))
        sorted_group = group[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
        self.rows = tuple(c[order[place < self.most]] for c in (group, score, id_, row))
        full = order[place == self.most - 1]
        self.least[group[full]] = score[full]


def _strips(n: int) -> Iterator[slice]:
    """Few columns first, so that most of the others fall short of what was found."""
    at, wide = 0, min(64, STRIP)
    while at < n:
        yield slice(at, at + wide)
        at, wide = at + wide, min(2 * wide, STRIP)


def _positives(most: int, chunk: int):
    """Pairs of blocks to each anchor's best rows of its label, of the task's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            for at, i in enumerate(batch.column("i").to_pylist()):
                (a_about, a), (about, b) = (_block(batch.column(x)[at], batch.column(y)[at]) for x, y in (("about", "v"), ("b_about", "b_v")))
                _, best = held.setdefault(i, (a_about.copy(), Best(len(a), most)))
                tile = tile_of(a, b, chunk)
                for some in _strips(len(b)):
                    row, id_, label = about[:, some]
                    group, x = np.nonzero((tile[:, some] >= best.least[:, None]) & (a_about[2][:, None] == label) & (a_about[0][:, None] != row))
                    best.add(group, tile[:, some][group, x], id_[x], row[x])
        for i, (a_about, best) in held.items():
            group, *rest = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(group), i)), pa.array(a_about[0][group]), *map(pa.array, rest)], names=["i", "anchor", "score", "id", "row"])

    return run


def _windows(most: int, low: tuple[int, int], chunk: int):
    """Pairs of blocks, with the positives of the anchors, to each window's best rows of other labels, of the task's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        held: dict[int, tuple] = {}
        for batch in batches:
            for at, i in enumerate(batch.column("i").to_pylist()):
                (a_about, a), (about, b) = (_block(batch.column(x)[at], batch.column(y)[at]) for x, y in (("about", "v"), ("b_about", "b_v")))
                if i not in held:
                    wanted = batch.column("positives")[at].values
                    anchor, p_row, p_id, score = (wanted.field(c).to_numpy().copy() for c in ("anchor", "row", "id", "score"))
                    by_row = np.argsort(a_about[0])
                    own = by_row[np.searchsorted(a_about[0], anchor, sorter=by_row)]
                    # The least whole number that is low[0] / low[1] of the score or more.
                    floor = np.array([-(-low[0] * s // low[1]) for s in score.tolist()], np.int64)
                    held[i] = own, (anchor, a_about[1][own], p_row, p_id, score), floor, a_about[2][own], Best(len(own), most)
                own, (*_, score), floor, a_label, best = held[i]
                tile = tile_of(a, b, chunk)
                for some in _strips(len(b)):
                    row, id_, label = about[:, some]
                    part = tile[:, some][own]
                    group, x = np.nonzero((part <= score[:, None]) & (part >= np.maximum(floor, best.least)[:, None]) & (a_label[:, None] != label))
                    best.add(group, part[group, x], id_[x], row[x])
        for _, of, _, _, best in held.values():
            group, *rest = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(c[group] for c in of), *rest)], names=names)

    return run


def mine_hard_negatives(
    df: DataFrame, anchor: Column, id_: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
    low: tuple[int, int] = (80, 100), scale: int = 256,
) -> DataFrame:
    """For each row of df where ``anchor`` (of its id) holds, and each of its best ``positives`` other rows of its label: the best ``negatives`` rows of
    other labels whose score is at most the positive's and at least low[0]/low[1] of it. Scores are inner products of floor(scale * x);
    higher ones come first, then smaller ids. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    # A pair of blocks is over 1 MB, and a batch of rows may hold many.
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    # Places in the written table tell repeated rows apart.
    rows = written(whole_vectors(df, id_, vector, label, scale).withColumn("row", F.monotonically_increasing_id()), "negatives-rows").select("row", "id", "label", "v")
    own = rows.where(anchor & (F.col("id") != NULL_ID))
    parts = max(1, -(-own.count() // HELD))
    blocks = written(rows.mapInArrow(_packed(ROWS), BLOCK), "negatives-blocks").select(F.col("about").alias("b_about"), F.col("v").alias("b_v"))
    blocks = blocks.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    anchors = written(own.repartition(parts, "row").mapInArrow(_packed(ANCHORS), BLOCK), "negatives-anchors")

    found = blocks.crossJoin(anchors.repartition(parts, "i")).mapInArrow(_positives(positives, CHUNK), BEST)
    by_score = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    best = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    # No more than ANCHORS times ``positives``.
    known = written(best.groupBy("i").agg(F.collect_list(F.struct("anchor", "row", "id", "score")).alias("positives")), "negatives-positives")
    asked = anchors.join(known, "i").repartition(parts, "i")
    found = blocks.crossJoin(asked).mapInArrow(_windows(negatives, low, CHUNK), FOUND)
    in_window = Window.partitionBy("anchor", "positive_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= negatives)
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return ranked.select(
        "anchor_id", shown("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), shown("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
