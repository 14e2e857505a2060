"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte class that separates words, and the words themselves.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see. Where the session names none, one is set if all of it runs on one machine, as in tests; else ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder as Parquet and reads it back.

    The folder belongs to the job; it may be cleared when the job's results are written."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of the Arrow batches that tasks get; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; a session that asks for smaller ones keeps them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key, None) or 0)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only; null keys get one too."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: At most this many keys are broadcast; the rest is joined by a shuffle.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left join on ``key``, which is unique in right and never null; right.``rows`` counts left's rows of the key.

    Keys that hold at least 1/HOT_KEYS of left's rows number HOT_KEYS at most. They are broadcast, so
    their rows stay where they are; the other keys are small and are shuffled."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    least = max(1, -(-total // HOT_KEYS))
    hot = F.broadcast(right.where(F.col(rows) >= least))
    near = left.join(hot, key)
    far = left.join(F.broadcast(right.where(F.col(rows) >= least).select(key)), key, "left_anti")
    return near.unionByName(far.join(right.where(F.col(rows) < least), key, "left"), allowMissingColumns=True)
