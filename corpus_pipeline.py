"""A corpus cleaned in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, mixing, pii, quality, simhash
from spanloom.llm.common import shared_dir, table, unused


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; a text that is null or empty goes."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with the words taken (repeats counted) and the figures of
    their sources; own columns of these names give way.

    Rows meet their figures by two hashes of the row and, among equal rows, by number."""
    names = ("size", "source_size", "target", "taken")
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    row, no = unused("mixed_row", docs), unused("mixed_no", docs)
    keyed = docs.withColumn(row, F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *plain).alias("b")))
    figures = mixing.mix(keyed, carry=(row,)).where("taken > 0").select(row, *names)
    figures = figures.withColumn(no, F.row_number().over(W.partitionBy(row).orderBy(F.desc("taken"))))
    keyed = keyed.withColumn(no, F.row_number().over(W.partitionBy(row).orderBy(F.lit(1))))
    return keyed.drop(*names).join(figures, [row, no]).drop(row, no)


STAGES = [
    ("quality_classifier", good),
    ("near_dedup", distinct),
    ("decontamination", unleaked),
    ("pii", private),
    ("mix", mixed),
]

#: No SQL says what the first four stages do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Every stage's rows go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
