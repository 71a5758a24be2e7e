"""From documents to packed training sequences, in stages that are each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` applies them to the table ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenceline.llm import mixing, packing, quality, queries, simhash, suffixes
from fenceline.llm.common import table
from fenceline.session import written

# Rows of a batch for Python workers: texts reach them some megabytes at a time, not ten thousand rows.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted to the labelled rows among ``docs``."""
    _small_batches(spark)
    scores = quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))
    return scores.where("predicted = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    _small_batches(spark)
    return simhash.one_of_each(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere, too. A null text stays null; a character of which a byte
    went goes altogether, and so do replacement characters of changed texts. A document of which nothing is left stays, empty."""
    _small_batches(spark)
    cleaned = suffixes.cleaned(docs)
    rest = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(rest)
    left = cleaned.withColumn("_text", text)
    return left.select(
        *[
            F.col("_text").alias(c) if c == "text" else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
            for c in docs.columns
        ]
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, in the order of a hash."""
    _small_batches(spark)
    return mixing.mixed(docs, mixing.rates(docs)).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a sequence."""
    _small_batches(spark)
    return packing.packed_pieces(written(queries.byte_pieces(docs), "pieces"), queries.SEQUENCE)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", long_repeats),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]
# Trained scores, XXH64 fingerprints and token ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
