"""Classes of near duplicates from banded signatures, without emitting the pairs of a bucket.

1. Documents with the same sequence of words are one node, the smallest id.
2. Nodes with equal bands share a bucket. A bucket's pivot is the node whose buckets hold the most nodes together, which in
   a group of copies is the text that they were made from. Each node is compared with the foremost of its pivots.
3. Verified links are contracted to components. For buckets that still hold several components, each node is noted as its
   difference from the bucket's pivot: the features that it lacks and those that it adds. A node that is not similar enough
   to the pivot itself can be so to another node only if the two share a good part of their differences, the more the
   farther the two are from the pivot (see ``meeting_rows``). Differences are ordered from rare to common among the pivot's
   nodes; a node keeps those that could be the first which it shares with a similar node of another component, given the
   nodes that hold the same difference. That is told by minima over the holders of a difference, not by pairs.
4. Where many nodes of several components still hold a difference, they are compared with one of them and contracted, as
   long as that links enough of them. The nodes that are left are joined on the differences kept, and compared.

So each two nodes that share a bucket are in one component, or compared, or can't be similar enough. A group of copies
costs one comparison a copy. Comparisons are exact: the Jaccard similarity of the two feature sets, in the JVM. Only a
group whose nodes are all just short of similar to each other, by the same differences, is compared pair by pair.

Scale: a signature is a few hundred bytes. Texts of nodes in shared buckets are shuffled once; a bit filter of their ids, of
bounded size, keeps back nearly all others (see ``exact_dedup``).
Bucket sums combine on the map side. Rows of large groups of copies and of large classes stay where they are and meet
their group by a broadcast of those groups, a thousand at most; other joins on hot keys are left to adaptive skew handling.
Between rounds, rows are written to the shared folder. Links and components never reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import NULL_ID, join_groups, order_id, written
from quarrylight.llm.components import components
from quarrylight.llm.exact_dedup import bit_filter, may_be_in
from quarrylight.llm.shingles import shingle_hashes, shingles_of, word_hashes

#: Against rounding, where whole numbers are compared with fractions.
SLACK = 1e-6
#: Pairs a row above which nodes that could meet are first thinned out by comparison with one of them.
CROWD = 16


def words_digest(hashed: np.ndarray) -> tuple[int, int]:
    """Two longs that tell a sequence of words."""
    digest = xxhash.xxh3_128_digest(hashed.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _signed(docs: DataFrame, banded: Callable, words: int) -> DataFrame:
    """docs (id, text) to id, h1 and h2 (of the sequence of words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, bands = [], [], []
            for text in batch.column(1).to_pylist():
                hashed = word_hashes(text)
                head, tail = words_digest(hashed)
                heads.append(head)
                tails.append(tail)
                bands.append(banded(shingles_of(hashed, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(heads, pa.int64()), pa.array(tails, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "h1", "h2", "bands"],
            )

    return docs.mapInArrow(run, "id long, h1 long, h2 long, bands array<long>")


def _features(docs: DataFrame, features: Callable, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [features(shingle_hashes(text, words)).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) whose feature sets are similar enough."""
    left = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    both = pairs.join(left, "b").join(right, "a").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.where(_similar(F.col("common"), union, threshold)).select("a", "b")


def _similar(common: F.Column, union: F.Column, threshold: float) -> F.Column:
    # Not below the threshold by rounding.
    return common + 1e-9 >= threshold * union


def differences(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (p, id) to n (features of p), lacks and adds (how many), delta (added features, then lacking ones, each
    sorted), linked (similar enough to p)."""
    own = sets.select("id", F.col("set").alias("own"))
    of_p = sets.select(F.col("id").alias("p"), F.col("set").alias("of_p"))
    both = pairs.join(own, "id").join(of_p, "p").select(
        "p", "id", F.size("of_p").alias("n"), F.array_sort(F.array_except("own", "of_p")).alias("added"), F.array_sort(F.array_except("of_p", "own")).alias("lacking"))
    out = both.select("p", "id", "n", F.size("lacking").alias("lacks"), F.size("added").alias("adds"), F.concat("added", "lacking").alias("delta"))
    return out.withColumn("linked", _similar(F.col("n") - F.col("lacks"), F.col("n") + F.col("adds"), threshold))


def _compared(pairs: DataFrame, noted: DataFrame, threshold: float) -> DataFrame:
    """pairs (p, a, b) that are similar enough, by their differences from p."""
    side = lambda x: noted.select("p", F.col("id").alias(x), "n", *[F.col(c).alias(f"{c}_{x}") for c in ("lacks", "adds", "delta")])
    both = pairs.join(side("a"), ["p", "a"]).join(side("b").drop("n"), ["p", "b"])
    shared = F.size(F.array_intersect("delta_a", "delta_b"))
    common = F.col("n") - F.col("lacks_a") - F.col("lacks_b") + shared
    union = F.col("n") + F.col("adds_a") + F.col("adds_b") - shared
    return both.where(_similar(common, union, threshold)).select("a", "b").distinct()


def _could_meet(rows: DataFrame) -> DataFrame:
    """Those of rows (p, feature, id, root, linked, over, rest) that a row of their feature, of another root and one of the two
    not linked, could be similar to: the best partner that the feature has is told by two minima."""
    groups = rows.groupBy("p", "feature").agg(
        F.min("over").alias("any_over"), F.min(F.when(~F.col("linked"), F.col("over"))).alias("open_over"), F.min("root").alias("least"), F.max("root").alias("most"))
    partner = F.when(F.col("linked"), F.col("open_over")).otherwise(F.col("any_over"))
    met = rows.join(groups.where("least < most and open_over is not null"), ["p", "feature"])
    return met.where(2 * F.col("rest") + SLACK >= F.col("over") + partner).select(*rows.columns)


def meeting_rows(noted: DataFrame, threshold: float) -> DataFrame:
    """noted (differences, and root) to a row for each difference by which a node could meet a similar one of another root:
    p, feature, id, root, linked, over, rest.

    Two sets A and B are similar enough if they differ by no more than c (|A| + |B|), c being (1 - t) / (1 + t). Let d(X) be
    the number of X's differences from p, and over(X) = d(X) - c |X|. A and B differ by d(A) + d(B) less twice the differences
    that they share, which must thus be at least (over(A) + over(B)) / 2. In an order of features that is the same for all
    nodes of p, let the first shared difference be A's i-th; then A and B share no more than rest = d(A) - i + 1.
    """
    noted = written(noted, "rooted")
    pivots = noted.groupBy("p").agg(F.bool_or(~F.col("linked")).alias("open"), F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("nodes"))
    noted = join_groups(noted, written(pivots.where("open and least < most").select("p", "nodes"), "open-pivots"), ["p"], "nodes")
    share = (1 - threshold) / (1 + threshold)
    over = F.size("delta") - share * (F.col("n") - F.col("lacks") + F.col("adds"))
    every = noted.select("p", "id", "root", "linked", "n", F.size("delta").alias("d"), over.alias("over"), F.explode("delta").alias("feature"))
    counts = every.groupBy("p", "feature").agg(F.count(F.lit(1)).alias("holders"))
    rare = Window.partitionBy("p", "id").orderBy("holders", "feature")
    placed = every.join(counts, ["p", "feature"]).withColumn("rest", F.col("d") - F.row_number().over(rare) + 1).where("holders > 1")
    # No partner is less over than p itself would be, and a linked node's partner is more over than the bound of links to p.
    least = F.when(F.col("linked"), share * F.col("n")).otherwise(-share * F.col("n"))
    placed = placed.where(2 * F.col("rest") + SLACK >= F.col("over") + least).select("p", "feature", "id", "root", "linked", "over", "rest")
    return written(_could_meet(_could_meet(placed)), "meeting")


def links_by_differences(noted: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """noted (differences from p) and roots (id, root) to the roots with all links among the nodes of each p."""
    rooted = lambda rows: rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = meeting_rows(rooted(noted), threshold)
    while True:
        groups = rows.groupBy("p", "feature").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("linked")).alias("open"))
        pairs, n = groups.agg(F.coalesce(F.sum(F.col("k") * F.col("open")), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        if pairs <= CROWD * n:
            break
        # Many could meet: each feature's nodes are compared with one of them, that which has most of p's features in common use.
        reach = rows.groupBy("p", "id").agg(F.count(F.lit(1)).alias("reach"))
        known = rows.join(reach, ["p", "id"])
        heads = known.groupBy("p", "feature").agg(F.max_by(F.struct("id", "root"), F.struct("reach", -F.col("id"))).alias("head"))
        asked = rows.join(heads, ["p", "feature"]).where("root <> head.root").select("p", F.col("id").alias("a"), F.col("head.id").alias("b")).distinct()
        found = written(_compared(asked, noted, threshold), "links")
        if found.count() * CROWD < heads.count():
            break
        roots = merged(roots, found)
        rows = written(_could_meet(rooted(rows.drop("root")).select(*rows.columns)), "meeting")
    one = rows.where("not linked").select("p", "feature", *[F.col(c).alias(f"{c}_a") for c in ("id", "root", "over", "rest")])
    other = rows.select("p", "feature", "linked", *[F.col(c).alias(f"{c}_b") for c in ("id", "root", "over", "rest")])
    could = (F.col("root_a") != F.col("root_b")) & (F.col("linked") | (F.col("id_a") < F.col("id_b"))) & (2 * F.least("rest_a", "rest_b") + SLACK >= F.col("over_a") + F.col("over_b"))
    pairs = one.join(other, ["p", "feature"]).where(could).select("p", F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    more = written(_compared(pairs, noted, threshold), "links")
    return roots if more.isEmpty() else merged(roots, more)


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) with links (a, b) added: only the roots that the links join go through the rounds again."""
    root_of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(ends)
    moved = roots.join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(tops), "roots")


def links_between(nodes: DataFrame, docs: DataFrame, features: Callable, threshold: float, words: int) -> DataFrame:
    """nodes (id, bands) and their texts to (id, root) for those that are not the smallest of their class."""
    none = nodes.sparkSession.createDataFrame([], "id long, root long")
    every = nodes.select("id", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("key", "n")
    rows = written(every.join(shared, "key"), "bucket-rows")
    if rows.isEmpty():
        return none
    fame = written(rows.groupBy("id").agg(F.sum("n").alias("fame")), "fame")
    wanted = fame.select("id")
    likely = may_be_in(docs, *bit_filter(wanted, fame.count()))
    # An inner join, as ids are distinct: a semi-join would be done before the filter.
    asked = likely.join(wanted.hint("shuffle_hash"), "id").select("id", "text")
    sets = written(_features(asked, features, words), "feature-sets")
    known = rows.select("key", "id").join(fame, "id")
    rank = F.struct("fame", -F.col("id"))
    pivots = known.groupBy("key").agg(F.max_by("id", rank).alias("p"), F.max(rank).alias("rank"))
    rows = written(rows.select("key", "id").join(pivots, "key"), "bucket-pivots")
    foremost = rows.groupBy("id").agg(F.max_by("p", "rank").alias("a")).where("a <> id").select("a", F.col("id").alias("b"))
    links = written(_verified(foremost, sets, threshold), "links")
    roots = none if links.isEmpty() else components(links)
    placed = rows.join(roots, "id", "left").select("key", "id", "p", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    pairs = placed.join(mixed, "key", "left_semi").where("id <> p").select("p", "id").distinct()
    noted = written(differences(pairs, sets, threshold), "differences")
    if noted.isEmpty():
        return roots
    direct = noted.where("linked").select(F.col("p").alias("a"), F.col("id").alias("b"))
    return links_by_differences(noted, merged(roots, direct), threshold)


def classes(df: DataFrame, doc_id: str, text: str, banded: Callable, features: Callable, threshold: float, words: int) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and class_size, a row for each row of df.

    ``banded`` gives the bands of a text's shingles, ``features`` their set; ``words`` make a shingle. Texts without words are copies of
    each other. Null ids come last. Rows that share an id are one node where they come first among their copies, and
    are else classified each by its own text.
    """
    docs = df.select(order_id(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    _, members, found = text_classes(written(_signed(docs, banded, words), "signatures"), docs, features, threshold, words)
    null = F.lit(NULL_ID)
    return join_groups(members, found, ["node"], "n").select(F.nullif("id", null).alias(doc_id), F.nullif("class_id", null).alias("class_id"), "class_size")


def text_classes(signed: DataFrame, docs: DataFrame, features: Callable, threshold: float, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A written table of id, h1, h2 (``words_digest``) and bands of docs (id, text) to copies (h1, h2, node, n), members (id, node) and
    the classes of nodes (node, n, class_id, class_size)."""
    copies = written(signed.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "copies")
    members = written(join_groups(signed.select("id", "h1", "h2"), copies, ["h1", "h2"], "n").select("id", "node"), "members")
    lone = members.where("id = node").select("id").distinct()
    nodes = signed.select("id", "bands").join(lone, "id", "left_semi")
    roots = links_between(nodes, docs, features, threshold, words).select(F.col("id").alias("node"), "root")
    # A class is known by its texts before it is by its documents.
    texts = copies.groupBy("node").agg(F.sum("n").alias("n"))
    placed = written(texts.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("class_id")), "text-classes")
    sizes = written(placed.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts")), "class-sizes")
    found = written(join_groups(placed, sizes, ["class_id"], "texts").select("node", "n", "class_id", "class_size"), "classes")
    return copies, members, found
