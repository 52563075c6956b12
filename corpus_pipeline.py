"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.

Defined results: other columns of the documents are left out; a null or empty text
passes the first and the third stage as it is, counts as a near duplicate of every
other one without words, and is a piece of length zero; rows that share an id are one
document from the second stage on, rows without an id all stay; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.llm import mixing, packing, pii, simhash, toxicity
from kernmill.llm.common import shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of a packing window, in the order of the mix: whole blocks of the mix.
WINDOW_DOCS = packing.BLOCK_DOCS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; it is trained on the labelled ones that are not held out."""
    return toxicity.accepted(docs.select(*COLUMNS), toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars is counted anew."""
    return pii.redacted(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files, and rows in them, ascend by slot."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = mixing.mixed(docs.select(*COLUMNS))
    return order.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its bin, and its text's place. Windows of the mix
    are packed one by one, so bins in ascending order keep the target weights;
    the mix's order is a function of the ids and sources, and read off again."""
    order = mixing.mixed(packing.measured(docs))
    items = order.withColumn("window", F.expr(f"slot div {max(1, WINDOW_DOCS // mixing.BLOCK)}"))
    return packing.pack(items.select("doc_id", "source", "length", "cluster", F.col("window").alias("block")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Toxicity scores and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
