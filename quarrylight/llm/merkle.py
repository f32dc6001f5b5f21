"""Merkle manifest: a tree over the rows of each group, a tree over the groups, and an inclusion proof for every row.

A level's nodes, three consecutive ones at a time (the last run may hold fewer, even one), become the digest of their
digests' hexadecimal text; a level with one node is the root of its tree. The roots of the groups (subroots) are the
leaves of the upper tree.

Building is event-driven. A node is an event for its parent. A parent's combiner gathers indexed digests of children; how
many it needs follows from the number of leaves and the parent's place. The event that completes it makes the parent an
event in turn, in the same task. Leaves are range-sorted, so nearly all parents are completed where their leaves lie; the
combiners still open at a task's end are the frontier. The frontier is reshuffled by the ancestor HEIGHT levels up, where all
children of every parent below it meet, then HEIGHT levels further, until nothing is open. A task holds a few open parents
for each level, after a shuffle no more than 3^HEIGHT nodes of a tree for each ancestor: no group, however large, is in one task.

Completed parents leave reverse links (parent to children's digests). Proofs come from the top: a block, which is a node
HEIGHT levels up, knows its own path to the root, its links give the paths of the nodes below, and these are the blocks of
the next step, down to the leaves. The steps are shuffles of blocks; their number is the tree's height by HEIGHT.

Nulls: a null group comes first, a null order value before others. Rows equal in group and order go by their digest; equal
rows are leaves of their own, each with its own proof. An empty table gives no rows. Other columns of the input are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import width, written

ARITY = 3
#: Levels that one shuffle resolves: 3^6 leaves are a block.
HEIGHT = 6
LINK, OPEN, ROOT = 0, 1, 2
NODES = "kind int, g string, n long, level int, idx long, digest string"
PATHS = "g string, n long, idx long, proof string, turns string, mark string"
HEX = 64
COLUMNS = ("g", "n", "at", "kind", "level", "idx", "proof", "turns", "mark")


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 over the columns: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def size_at(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // ARITY**level)


def depth(n: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climb(nodes: Iterable[tuple[str, int, int, int, str]]) -> Iterator[tuple]:
    """Events (g, n, level, idx, digest) to links, then roots on the way, and what stays open at the end."""
    combiners: dict[tuple[str, int, int], dict[int, str]] = {}
    sizes: dict[tuple[str, int, int], int] = {}
    for g, n, level, i, digest in nodes:
        while True:
            here = size_at(n, level)
            if here == 1:
                yield ROOT, g, n, level, 0, digest
                break
            parent = i // ARITY
            key = (g, level + 1, parent)
            children = combiners.setdefault(key, {})
            children[i] = digest
            if len(children) < min(ARITY, here - parent * ARITY):
                sizes[key] = n
                break
            del combiners[key]
            sizes.pop(key, None)
            joined = "".join(children[c] for c in sorted(children))
            yield LINK, g, n, level + 1, parent, joined
            level, i, digest = level + 1, parent, digest_of(joined)
    for key, children in combiners.items():
        for i, digest in children.items():
            yield OPEN, key[0], sizes[key], key[1] - 1, i, digest


def _climbing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def events() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("g", "n", "level", "idx", "digest")), strict=True)

    types = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    names = ["kind", "g", "n", "level", "idx", "digest"]
    rows: list[tuple] = []
    for row in climb(events()):
        rows.append(row)
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def ancestor(height: int) -> Column:
    """The index of a node's ancestor at ``height``, no more than HEIGHT levels up; its own from there on."""
    steps = F.array(*[F.lit(ARITY ** min(height - at, HEIGHT)).cast("long") for at in range(height + 1)])
    step = F.element_at(steps, F.least(F.col("level"), F.lit(height)) + 1)
    return ((F.col("idx") - F.pmod("idx", step)) / step).cast("long")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with a column g, range-sorted by g and order, with pos (from 0) and n in their g."""
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(width(rows.sparkSession), "g", *order, "tie").sortWithinPartitions("g", *order, "tie").drop("tie")
    schema = ranged.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("local")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for g in batch.column("g").to_pylist():
                at = at + 1 if g == last else 0
                last = g
                local.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=schema.names)

    placed = written(ranged.mapInArrow(run, schema), "merkle-sorted")
    # A row for each range of a group: no more than there are groups and ranges together.
    runs = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("g").orderBy("part")
    runs = runs.select("g", "part", F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    return placed.join(runs, ["g", "part"]).withColumn("pos", F.col("offset") + F.col("local")).drop("part", "local", "offset")


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """leaves (g, n, pos, leaf) to links (g, n, level, idx, digest: the children's), roots (g, n, digest), and the greatest
    height."""
    first = leaves.select("g", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest")).sortWithinPartitions("g", "idx")
    made = written(first.mapInArrow(_climbing, NODES), "merkle-nodes")
    everything, height = made, 0
    while True:
        frontier = made.where(F.col("kind") == OPEN).drop("kind")
        if frontier.isEmpty():
            break
        height += HEIGHT
        below = frontier.withColumn("at", ancestor(height))
        made = written(below.repartition(width(leaves.sparkSession), "g", "at").drop("at").mapInArrow(_climbing, NODES), "merkle-nodes")
        everything = everything.unionByName(made)
    links = everything.where(F.col("kind") == LINK).drop("kind")
    roots = everything.where(F.col("kind") == ROOT).select("g", "n", "digest")
    return links, roots, depth(leaves.agg(F.max("n")).first()[0] or 0)


def fold(digest: str, proof: str, turns: str) -> str:
    """The root that a leaf's digest, its siblings' digests and its places give. ``turns`` has two digits a level: the place
    among the run's nodes and their number."""
    at = 0
    for level in range(0, len(turns), 2):
        place, run = int(turns[level]), int(turns[level + 1])
        middle = at + place * HEX
        end = at + (run - 1) * HEX
        digest = digest_of(proof[at:middle] + digest + proof[middle:end])
        at = end
    return digest


class _Block:
    """The paths of the nodes under one block."""

    def __init__(self):
        self.key, self.n = None, 0

    def begin(self, key: tuple[str, int], n: int) -> None:
        self.key, self.n, self.top, self.mark, self.paths, self.links = key, n, ("", ""), "", {}, {}

    def path(self, level: int, i: int, top: int) -> tuple[str, str]:
        if level == top:
            return self.top
        found = self.paths.get((level, i))
        if found is None:
            parent, place = divmod(i, ARITY)
            children = self.links[level + 1, parent]
            above = self.path(level + 1, parent, top)
            siblings = children[: place * HEX] + children[(place + 1) * HEX :]
            found = siblings + above[0], f"{place}{len(children) // HEX}" + above[1]
            if level:
                self.paths[level, i] = found
        return found


def descend(links: DataFrame, tops: DataFrame, height: int, leaves: DataFrame, extra: list[str]) -> DataFrame:
    """tops (g, n, proof, turns: the path of the tree's root; mark) and leaves (g, n, pos, the extra columns) to the leaves with
    their proof, turns and tree's mark."""
    spark = leaves.sparkSession
    rounds = max(1, -(-height // HEIGHT))
    levels = F.lit(0)
    for d in range(1, rounds * HEIGHT + 1):
        levels = levels + (F.col("n") > ARITY ** (d - 1)).cast("int")
    tops = tops.withColumn("depth", levels)
    none = F.lit(None).cast("string")
    paths = None
    for r in reversed(range(rounds)):
        base, over = r * HEIGHT, (r + 1) * HEIGHT
        own = tops.where((F.col("depth") <= over) & ((F.col("depth") > base) | F.lit(r == 0)))
        upper = own.select("g", "n", F.lit(0).cast("long").alias("at"), "proof", "turns", "mark")
        if paths is not None:
            upper = upper.unionByName(paths.select("g", "n", F.col("idx").alias("at"), "proof", "turns", "mark"))
        upper = upper.select("g", "n", "at", F.lit(0).alias("kind"), F.lit(over).alias("level"), F.lit(0).cast("long").alias("idx"), "proof", "turns", "mark")
        inside = links.where((F.col("level") > base) & (F.col("level") <= over))
        inside = inside.select("g", "n", ancestor(over).alias("at"), F.lit(1).alias("kind"), "level", "idx", F.col("digest").alias("proof"), none.alias("turns"), none.alias("mark"))
        rows = upper.unionByName(inside)
        if r == 0:
            block = leaves.select("g", "n", F.floor(F.col("pos") / ARITY**HEIGHT).cast("long").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("level"), F.col("pos").alias("idx"), none.alias("proof"), none.alias("turns"), none.alias("mark"), F.struct(*extra).alias("row"))
            rows = rows.withColumn("row", F.lit(None).cast(block.schema["row"].dataType)).unionByName(block)
        dealt = rows.repartition(width(spark), "g", "at").sortWithinPartitions("g", "at", "kind")

        def run(batches: Iterator[pa.RecordBatch], base: int = base, over: int = over) -> Iterator[pa.RecordBatch]:
            block = _Block()
            for batch in batches:
                picked, found = [], []
                kinds = batch.column("kind").to_pylist()
                for k, (g, n, at, kind, level, i, proof, turns, mark) in enumerate(zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True)):
                    if block.key != (g, at):
                        if block.key:
                            found += block_paths(block)
                        block.begin((g, at), n)
                    if kind == 0:
                        block.top, block.mark = (proof, turns), mark
                    elif kind == 1:
                        block.links[level, i] = proof
                    else:
                        picked.append(k)
                        found.append((*block.path(0, i, min(over, depth(n))), block.mark))
                if base:
                    yield table_of(found)
                elif picked:
                    rest = batch.column("row").take(pa.array(picked))
                    yield pa.RecordBatch.from_arrays([rest, *(pa.array(c, pa.string()) for c in zip(*found, strict=True))], names=["row", "proof", "turns", "mark"])
            if base and block.key:
                yield table_of(block_paths(block))

        def block_paths(block: _Block, base: int = base, over: int = over) -> list[tuple]:
            """The paths of a block's lowest nodes, where they are the blocks of the next step."""
            if not base:
                return []
            top = min(over, depth(block.n))
            found = []
            for (level, parent), children in block.links.items():
                if level == base + 1:
                    for place in range(len(children) // HEX):
                        i = parent * ARITY + place
                        found.append((block.key[0], block.n, i, *block.path(base, i, top), block.mark))
            return found

        def table_of(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=["g", "n", "idx", "proof", "turns", "mark"])

        if r:
            paths = written(dealt.mapInArrow(run, PATHS), "merkle-paths")
        else:
            schema = dealt.select("row", *[F.lit("").alias(c) for c in ("proof", "turns", "mark")]).schema
            out = dealt.mapInArrow(run, schema)
    return out.select("row.*", "proof", "turns", "mark")


def merkle_manifest(df: DataFrame, leaf: Column, claim: Column | None = None, group: str = "source", order: str = "doc_id") -> DataFrame:
    """A row for each row of df: order, leaf, subroot, root, proof (the siblings' digests from the leaf to the root, left to
    right), turns (its places, for ``fold``), folded_root (what ``claim``, the digest of a row to be verified, gives with this
    proof) and verified (it is the root). Without a claim, the leaf is verified."""
    g = F.col(f"`{group}`").cast("string")
    rows = df.select(F.col(f"`{order}`").alias("id"), F.coalesce(F.concat(F.lit("="), g), F.lit("-")).alias("g"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim"))
    # Texts are hashed once: sorting by ranges reads its rows twice.
    leaves = numbered(written(rows, "merkle-leaves"), ["id", "leaf"])
    links, subroots, height = build(leaves)
    groups = numbered(subroots.select(F.col("g").alias("name"), F.col("n").alias("leaves"), F.lit("").alias("g"), F.col("digest").alias("leaf")), ["name"])
    upper_links, root, upper_height = build(groups)
    empty = F.lit("")
    above = descend(upper_links, root.select("g", "n", empty.alias("proof"), empty.alias("turns"), F.col("digest").alias("mark")), upper_height, groups, ["name", "leaves", "leaf"])
    tops = written(above.select(F.col("name").alias("g"), F.col("leaves").alias("n"), "proof", "turns", F.concat("leaf", "mark").alias("mark")), "merkle-groups")
    done = folded(descend(links, tops, height, leaves, ["id", "leaf", "claim"]))
    subroot, top = F.substring("mark", 1, HEX), F.substring("mark", HEX + 1, HEX)
    return done.select(F.col("id").alias(order), "leaf", subroot.alias("subroot"), top.alias("root"), "proof", "turns", "folded_root", (F.col("folded_root") == top).alias("verified"))


def folded(rows: DataFrame) -> DataFrame:
    """rows (claim, proof, turns, ...) with folded_root."""
    schema = rows.select("*", F.lit("").alias("folded_root")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [fold(c, p, t) for c, p, t in zip(*(batch.column(x).to_pylist() for x in ("claim", "proof", "turns")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
