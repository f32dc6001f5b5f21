"""What the corpus operators share: scratch folders, session defaults and column handling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.scratch import shared_dir

#: ``[\x20\x09-\x0D]``, the white space of the contracts.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null document id where ids are ordered: null ids come last and count as one document.
NULL_ID = 2**63 - 1
#: Keys with over a SHARE-th of the rows are hot; there can be no more of them than this.
SHARE = 1000
#: Documents in one Arrow batch. A batch of long texts must fit a Python worker several times over.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as whole texts travel in them, and a checkpoint folder where none is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared_dir(spark)
    return spark


_scratched: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratched.append(path)
    return path


def drop_scratch(spark: SparkSession, since: str | None = None) -> None:
    """Deletes what this session's operators wrote to the shared folder, or what they wrote after the path ``since``; to be
    called when their results are stored."""
    first = _scratched.index(since) + 1 if since else 0
    dropped = _scratched[first:]
    del _scratched[first:]
    for name in dropped:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_id(column: str | Column) -> Column:
    """A document id as a long for which null comes last."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined to their groups by keys that are not null. ``n`` is a group's number of rows: groups with over a SHARE-th
    of all rows, SHARE at most, are broadcast, so that their rows stay where they are; only the others are shuffled.
    Both tables are read twice and should be written ones."""
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * SHARE > total
    hot = groups.where(is_hot)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(groups.where(~is_hot), keys))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def replace_columns(df: DataFrame, row: str, new: dict[str, Column]) -> DataFrame:
    """The fields of the struct ``row`` and the new columns; a new column replaces a field of its name in any case."""
    taken = {name.lower() for name in new}
    kept = [F.col(row)[f].alias(f) for f in df.schema[row].dataType.names if f.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in new.items()])


def as_row(df: DataFrame, name: str = "__row") -> Column:
    """All columns as one struct, so that the names an operator uses inside can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
