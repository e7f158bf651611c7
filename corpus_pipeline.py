"""The corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed to weights, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one packed pieces. ``run`` writes
each stage's result as Parquet in the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm import exact_dedup, mixing, packing, simhash, toxicity
from branchwise.llm.tokens import default_vocabulary
from branchwise.session import ship_package, stored

#: SQL can express neither the fitted model nor the search, so tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject, unchanged. It is fitted on labelled rows; without labels of both
    kinds all stay. Null and empty texts have no terms and stay; repeated rows share their verdict; an empty table stays
    empty. Columns may have any names."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts equal but for A-Z case, that with the largest id. Null text is empty text; a null id
    stays only where no copy has an id; of rows alike in id and text one stays; an empty table stays empty. Columns may
    have any names."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (fingerprints of 4-word shingles at most 4 bits apart, linked on), that
    with the smallest id. Texts without words are one group; a null id stays only where its group has no id; of rows alike
    in id and text one stays; an empty table stays empty. Columns may have any names."""
    ship_package(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document cut by its source's budget keeps its first words. Texts without
    words and null texts have size 0 and are not taken; a null source is a source of its own; rows alike share what they
    take; an empty table stays empty. Columns may have any names."""
    ship_package(spark)
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids. Null and empty texts are their end id; repeated rows and null ids are packed
    like others; a very long text fills windows of its own; an empty table gives no pieces."""
    ship_package(spark)
    return packing.packed(docs, default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
