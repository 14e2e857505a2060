"""Work that is done once and kept: an index of chunks that grows with its documents, and a reader's answers.

A run writes into a folder that its input names, and what was written before is found by its content. So a run that is
repeated, whole or after it failed half way, leaves the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..tables import written
from .rollups import request_keys

_CHUNKS = "doc_key string, doc_id long, chunk_number int, content string"
_RUNS = "run string, documents long, chunks long, status string"


def _table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows at path, none if nothing was written there yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _run_name(keys: DataFrame) -> tuple[str, int]:
    """A name that depends on a set of different keys only, and how many they are."""
    total, n = keys.agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return f"{n}-{int(total or 0) % 2**64:016x}", n


def incremental_index(docs: DataFrame, path: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Adds the chunks of texts that the index at path doesn't have yet, and gives the whole index (doc_key, doc_id, chunk_number, content).

    docs: (doc_id, text). A text of a document is known by the digest of both, so a changed text is a new one and its older chunks stay, told apart by doc_key. Null and
    empty texts have no chunks; repeated rows count once. Each run's chunks are one folder, named by what they are made of and written as a whole; see ``run_status``."""
    spark = docs.sparkSession
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    texts = docs.where("text <> ''").select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["key"])
    had = _table(spark, f"{path}/chunks", _CHUNKS).select(F.col("doc_key").alias("key")).distinct()
    new = texts.join(had, "key", "left_anti")
    run, n = _run_name(new.select("key"))
    if n:
        starts = F.sequence(F.lit(1), F.length("text"), F.lit(size - overlap))
        rows = new.select(F.col("key").alias("doc_key"), "doc_id", "text", F.posexplode(starts).alias("pos", "start"))
        rows = rows.select("doc_key", "doc_id", (F.col("pos") + 1).alias("chunk_number"), F.substring(F.col("text"), F.col("start"), F.lit(size)).alias("content"))
        rows.write.mode("overwrite").parquet(f"{path}/chunks/run-{run}")
        written = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks/run-{run}").count()
        status = spark.createDataFrame([(run, n, written, "success")], _RUNS)
    else:
        status = spark.createDataFrame([("none", 0, 0, "nothing new")], _RUNS)
    status.coalesce(1).write.mode("overwrite").parquet(f"{path}/last_run")
    return _table(spark, f"{path}/chunks", _CHUNKS)


def run_status(spark: SparkSession, path: str) -> DataFrame:
    """The last run over an index (run, documents, chunks, status); no row before the first."""
    return _table(spark, f"{path}/last_run", _RUNS)


def with_reader(requests: DataFrame, fields: tuple[str, ...], reader: Callable[[pd.DataFrame], pd.DataFrame], schema: str, path: str) -> DataFrame:
    """requests with the answers of ``reader``, each distinct request read once and kept at path.

    reader takes a frame of the fields of one batch and gives as many rows of ``schema``, in order. A request that makes its whole batch fail is read again alone, and if it fails then has nulls and
    the error's text in ``error``. Answers are kept with the key of their request, each once; errors don't count as answers, so a later call asks again. How many readers run at a time is how many tasks run."""
    spark = requests.sparkSession
    answers = StructType([*_parse_datatype_string("request_key string").fields, *_parse_datatype_string(schema).fields, *_parse_datatype_string("error string").fields])
    names = [f.name for f in answers.fields[1:-1]]
    # the work is on the different requests; all of them meet the answers by their fields, so that long keys aren't sent with each
    different = written(request_keys(requests.select(*fields).distinct(), fields))
    known = _table(spark, path, answers).where("error IS NULL").dropDuplicates(["request_key"])
    new = different.join(known.select("request_key"), "request_key", "left_anti")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = reader(batch[list(fields)]).assign(error=None)
                if len(out) != len(batch):
                    raise ValueError(f"{len(out)} answers to {len(batch)} requests")
            except Exception:  # the reader is the user's: any error of it is an answer of that request
                out = pd.concat([_alone(reader, batch[list(fields)].iloc[[i]], names) for i in range(len(batch))])
            out.insert(0, "request_key", batch["request_key"].to_numpy())
            yield out[[f.name for f in answers.fields]]

    def answered(kept: DataFrame) -> DataFrame:
        found = different.join(kept, "request_key", "left").select("request_key", *(F.col(f).alias(f"asked_{i}") for i, f in enumerate(fields)), *names, "error")
        same = [F.col(f).eqNullSafe(F.col(f"asked_{i}")) for i, f in enumerate(fields)]
        return requests.join(found, reduce(and_, same), "left").select("request_key", *requests.columns, *names, "error")

    if new.isEmpty():
        return answered(known)
    # a folder of its own: what is read again is read while it is written
    folder = f"{path}/run-{uuid.uuid4().hex}"
    # few rows and slow readers: they go to all tasks that can run, and not to as many as their size asks for
    new.repartition(spark.sparkContext.defaultParallelism, "request_key").mapInPandas(read, answers).write.parquet(folder)
    return answered(known.unionByName(spark.read.schema(answers).parquet(folder)))


def _alone(reader: Callable[[pd.DataFrame], pd.DataFrame], request: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    try:
        return reader(request).assign(error=None)
    except Exception as e:
        return pd.DataFrame([dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}])
