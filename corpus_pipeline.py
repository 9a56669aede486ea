"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import scratch, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    from cellweave.llm.quality_rules import judge

    return judge(docs.select(*COLUMNS), carry=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of their kind vote for."""
    from cellweave.llm.neighbours import fit, keep_good

    docs = docs.select(*COLUMNS)
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    from cellweave.llm.jaccard_join import deduplicate

    return deduplicate(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by output shard and in the shard's order."""
    from cellweave.llm.mixing import drawn, mix

    docs = docs.select(*COLUMNS)
    return drawn(mix(docs, keep=("text", "lang", "source", "n_chars"))).select(*COLUMNS, "shard", "local_order").repartition("shard", F.pmod("local_order", F.lit(64))).sortWithinPartitions("shard", "local_order").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    from cellweave.llm.packing import pack

    return pack(docs)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Neighbour voting, mixing and packing have no SQL form: tests/llm holds the first three stages against brute force and
#: the last two against what they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage wrote for itself is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
