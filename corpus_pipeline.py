"""Corpus pipeline: documents to token rows in five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.mixing import mix
from paperlake.llm.near_dups import near_duplicates
from paperlake.llm.piece_tokens import encode
from paperlake.llm.secrets import redact_secrets
from paperlake.llm.shared import written
from paperlake.llm.toxicity import drop_toxic, fit


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column has; Spark's names don't tell cases apart."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose whole text the classifier, trained on the labelled ones, rejects.

    Null and empty texts score 0 and stay; repeated rows are judged alike; an empty table stays empty, and without
    toxic labels nothing is dropped."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group at a similarity of 0.8: that with the smallest id (rows without an id come last).

    Rows are judged and not ids: of rows that repeat an id and a text one stays, and texts that share an id
    are told apart. Rows without any word are kept, as they have nothing in common. An empty table stays empty."""
    key = _free(docs, "row_key")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent=80).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", key)
    first = found.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min_by(key, order).alias(key)).select(key)
    return rows.join(first, key, "left_semi").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets; n_chars follows where the text changed.

    Each row gives one; null texts stay null, empty ones empty."""
    before = _free(docs, "text_before")
    clean = redact_secrets(docs.select("*", F.xxhash64("text").alias(before)))
    changed = F.xxhash64("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as its source's rate says; a rate below one leaves some out.

    Null sources are one source, null texts have no words; rows of one id get the same number of copies."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of docs with its piece ids; null and empty texts have none."""
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("secrets", secrets),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: SQL can't train the classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
