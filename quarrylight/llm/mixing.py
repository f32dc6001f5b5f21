"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order (by the MD5 of the id), repeated for as many epochs as the mix
allows. A document's virtual finish time is the cumulative words of its queue up to and including it, divided by the
target weight of its source, which is the words the source should give. All queues are served at those rates, so the
documents sorted globally by finish time are the mix, which is truncated where the cumulative words reach the budget.

As one long document can hold more words than its source should give, documents are queued in packets: a packet is a
document's words or a 65,536-th of its source's, whichever is less, with a finish time of its own. Packets are ranged by
finish time; as all queues are served at once, ranges of equal width hold about equal numbers of words. Sums by range tell
the range in which the budget ends; what lies before is taken, that range is sorted, and its packets are taken up to the
budget, the last one in part. A document is taken up to the words that its source gave until then. So every source gives
its target but for a packet or two.

Targets: sources by code point, null last, take the weights in turn and share ``share`` times all words; none gets more
than ``epochs`` times its own words, and the excess is shared among the rest by weight (water filling).

Scale: the schedule is made of one slim row a document, written once. The cumulative sum of a queue is taken in two levels:
sums for each of 4096 ranges of the shuffle key, then a running sum inside each range, so that a source with most of the
documents is still spread over thousands of tasks. There are no more packets than words, and no more than one for each time
that a document can be taken and 131,072 a source; they are summed on the map side. The driver gets the sums of 8,193 ranges
of finish time. One task sorts the range that holds the cut, a 4096-th of the mix; the table of sources, one row each, is
swept in one task, too.

Null texts have size 0. Null sources form one source. Documents of size 0 take nothing. Rows with equal ids are apart in
the queue by size and a hash of the text, and each keeps its own row. Sources without words have target 0. Columns of the
input stay, but for those named like a result column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import as_row, replace_columns, width, written

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the shuffle key that make a range: 4096 ranges.
DIGITS = 3
#: Packets of a source, if its documents are long, and ranges of the virtual time in which the budget should be spent.
PACKETS, RANGES = 1 << 16, 1 << 12
SOURCE = ["name", "nameless"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """sizes (source, source_size) with target: the level of the water is taken where the first source is not full."""
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    by_level = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    table = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("double"))
    table = table.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    budget = F.sum("source_size").over(everything).cast("double") * share
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (budget - before) / rest)
    full = F.col("cap") / F.col("weight") <= F.col("level")
    water = F.max(F.when(~full, F.col("level"))).over(everything)
    return table.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * water)).select("source", "source_size", "target")


def sized(df: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    """A row a document: doc_id, name and nameless (the source, in columns without nulls), size, key and tie (of the queue), part."""
    key = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))
    name = F.col(f"`{source}`").cast("string")
    return df.select(
        *more, F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(name, F.lit("")).alias("name"), name.isNull().alias("nameless"), n_words(F.col(f"`{text}`")).alias("size"),
        key.alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tie"),
    ).withColumn("part", F.substring("key", 1, DIGITS))


def placed(rows: DataFrame, slim: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """rows (as sized, written as slim) with source_size, target and start (words of the queue before them)."""
    sums = slim.groupBy(*SOURCE, "part").agg(F.sum("size").alias("part_size"))
    sizes = sums.groupBy(*SOURCE).agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col("nameless"), F.col("name")).alias("source"), "source_size"), weights, share, epochs)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), "source_size", "target")
    before = Window.partitionBy(*SOURCE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0))).join(targets, SOURCE)
    inside = Window.partitionBy(*SOURCE, "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = queued.join(offsets.select(*SOURCE, "part", "offset", "source_size", "target"), [*SOURCE, "part"])
    return joined.withColumn("start", F.col("offset") + F.col("inner")).drop("offset", "inner", "key", "tie", "part")


def turns_of(queue: DataFrame, epochs: int) -> DataFrame:
    """A row for each document and epoch: begin (words of the queue before it)."""
    turns = queue.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    return turns.withColumn("begin", F.col("start") + F.col("epoch") * F.col("source_size"))


def packets_of(turns: DataFrame) -> DataFrame:
    """Each turn in packets: name, nameless, at (the source's words up to and including it), words, finish."""
    most = F.expr(f"(source_size + {PACKETS - 1}) div {PACKETS}")
    cut = turns.where("size > 0").withColumn("most", most).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("(size + most - 1) div most"))))
    upto = F.least(F.col("i") * F.col("most"), F.col("size"))
    rows = cut.select(*SOURCE, "target", (F.col("begin") + upto).alias("at"), (upto - (F.col("i") - 1) * F.col("most")).alias("words"))
    return rows.withColumn("finish", F.col("at") / F.col("target"))


def served(queue: DataFrame, share: float, epochs: int) -> DataFrame:
    """queue (as placed) to name, nameless and served: the words that each source gives until the budget is spent."""
    # Ranges past twice the time are one; the budget is spent before them.
    ranged = packets_of(turns_of(queue, epochs)).withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)).cast("int"))
    by_source = written(ranged.groupBy("range", *SOURCE).agg(F.sum("words").alias("words")), "range-sums")
    sums = sorted(by_source.groupBy("range").agg(F.sum("words").alias("words")).collect())
    budget = math.floor(float(queue.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * min(share, epochs))
    last, before = 0, 0
    for last, words in sums:
        if before + words >= budget:
            break
        before += words
    whole = by_source.where(F.col("range") < last).select(*SOURCE, "words")
    order = Window.partitionBy("range").orderBy("finish", "nameless", "name", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    final = ranged.where(F.col("range") == last).withColumn("past", F.sum("words").over(order) - F.lit(budget - before))
    cut = final.select(*SOURCE, F.greatest(F.lit(0), F.least(F.col("words"), F.col("words") - F.col("past"))).alias("words"))
    return written(whole.unionByName(cut).groupBy(*SOURCE).agg(F.sum("words").alias("served")), "served")


def taken(turns: DataFrame, given: DataFrame) -> DataFrame:
    """turns with finish (virtual time) and words (taken before the budget is spent; 0 past the cut)."""
    found = turns.join(given, SOURCE, "left")
    finish = F.when(F.col("target") > 0, (F.col("begin") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    left = F.coalesce("served", F.lit(0)) - F.col("begin")
    return found.withColumns({"finish": finish, "words": F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")})


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mix in order: df's columns, a row for each time that a document is taken, its text cut after the words taken,
    with epoch, finish and words. Texts are shuffled to their queues and with the global sort of what is taken."""
    slim = written(sized(df, doc_id, text, source), "queue")
    given = served(written(placed(slim, slim, weights, share, epochs), "places"), share, epochs)
    rows = placed(sized(df, doc_id, text, source, as_row(df)), slim, weights, share, epochs)
    order = ["finish", "nameless", "name", "doc_id", "epoch"]
    chosen = taken(turns_of(rows, epochs), given).where("words > 0").repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order)
    whole = F.col(f"__row.`{text}`")
    # White space inside the part that is taken stays as it is.
    head = F.regexp_extract(whole, r"^[\x20\x09-\x0D]*", 0)
    cut = F.when(F.col("words") == F.col("size"), whole).otherwise(F.concat(head, first_words(F.substr(whole, F.length(head) + 1), F.col("words"))))
    return replace_columns(chosen, "__row", {
        **{c: F.col(f"__row.`{c}`") for c in df.columns if c != text}, text: cut,
        "mix_epoch": F.col("epoch"), "mix_finish": F.col("finish"), "mix_words": F.col("words"),
    })


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; it must begin with a word."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(words, F.lit(1), n.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def words_taken(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """A row for each document, also those not taken: doc_id, size, source_size, target, taken (repeats counted), turns."""
    slim = written(sized(df, doc_id, text, source), "queue")
    queue = written(placed(slim, slim, weights, share, epochs), "places")
    given = served(queue, share, epochs)
    # The words of each epoch follow from those that the source gave; no row is copied.
    of_epoch = [F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("served", F.lit(0)) - F.col("start") - e * F.col("source_size"))) for e in range(epochs)]
    add = lambda columns: sum(columns[1:], columns[0]).cast("long")
    return queue.join(given, SOURCE, "left").select(
        F.col("doc_id").alias(doc_id), "size", "source_size", "target", add(of_epoch).alias("taken"), add([(words > 0).cast("long") for words in of_epoch]).alias("turns"))
