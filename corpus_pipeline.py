"""A training corpus from documents: quality filter, line dedup, near dedup, source mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All but the last return
the columns of documents; n_chars is that of the text as it is then. The mix returns a row for each time that a document
is taken, the one that is being served at the cut with the words served. Nulls are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.bpe import encode
from quarrylight.llm.common import drop_scratch, prepare, scratch
from quarrylight.llm.dart_minhash import near_dedup
from quarrylight.llm.line_dedup import dedup_lines
from quarrylight.llm.mixing import mix
from quarrylight.llm.quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be of quality 0."""
    prepare(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller id holds as well. Every document stays, if need be with an empty text."""
    prepare(spark)
    return as_documents(dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    prepare(spark)
    return near_dedup(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each source its target share."""
    prepare(spark)
    return as_documents(mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids again."""
    prepare(spark)
    out = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("mixing", mixing), ("byte-level BPE", tokens)]
#: SQL can't express the classifier and the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder before the next; what a stage wrote on its way is then
    deleted."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        drop_scratch(spark, since=path)
    return STAGES[-1][1](spark, docs, sf_dir)
