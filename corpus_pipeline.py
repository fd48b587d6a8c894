"""Documents to a training mix: quality, near-duplicates, benchmark passages, secrets, source weights.

Every stage reads all rows that the one before kept; all but the last return the columns of
``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm import decontaminate, hyperminhash, mixing, quality, secrets
from metricloom.llm.store import written

#: A document goes when more than this share of its words lies in benchmark passages. One quoted
#: window counts: what a benchmark asks must not be trained on at all.
CONTAMINATED_ABOVE = 0.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=CONTAMINATED_ABOVE)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("secrets", secret_values),
    ("source mix", source_mix),
]

#: The fitted reliabilities of the first stage have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
