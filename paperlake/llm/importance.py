"""Target-distribution importance resampling over hashed n-grams.

Texts become words with single spaces between them; a regular expression with boundary lookarounds, matched
with overlaps, gives every n-gram's span, and the CRC of the span's bytes its bucket. Buckets' counts in the
corpus and in the target texts give each bucket a gain; a document's weight is the sum of its features' gains,
and seeded Gumbel noise makes the highest scores a weighted draw without replacement.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import pieces
from .shared import bounded_batches, written

#: Words are runs of ASCII digits and letters, A-Z lower-cased, and of all bytes from 128 on; every other byte separates.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def collapsed(text: bytes) -> bytes:
    """The words with one space between them."""
    return b" ".join(text.translate(_WORD_BYTES).split())


def gram_pattern(n: int) -> regex.Pattern:
    """Matches, with overlaps, every run of n words of a collapsed text: nothing but a space or an end stands beside it."""
    return regex.compile(rb"(?<![^ ])" + rb"[^ ]++ " * (n - 1) + rb"[^ ]++(?![^ ])")


def buckets_of(words: bytes, patterns: list[regex.Pattern], buckets: int) -> Counter:
    """How many n-grams of a collapsed text each bucket gets; at most ``buckets`` numbers whatever the text's length."""
    out: Counter = Counter()
    for p in patterns:
        spans = (m.span() for m in p.finditer(words, overlapped=True))
        out.update([crc32(words[a:b]) % buckets for a, b in spans] if len(words) < 1 << 20 else (crc32(words[a:b]) % buckets for a, b in spans))
    return out


def _features(least: int, most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [gram_pattern(n) for n in range(least, most + 1)]
        for part, data, at in pieces(batches):
            raw = data.tobytes()
            words = [collapsed(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = [sorted(buckets_of(w, patterns, buckets).items()) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([w.count(b" ") + 1 if w else 0 for w in words], pa.int64()), pa.array([sum(c for _, c in f) for f in found], pa.int64()),
                    pa.array([[b for b, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "n_words", "n_features", "bucket", "times"],
            )

    return run


def features(docs: DataFrame, least: int, most: int, buckets: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, bucket, times): each text's runs of ``least`` to ``most`` words by bucket, buckets ascending."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(_features(least, most, buckets), "doc_id long, n_words long, n_features long, bucket array<int>, times array<int>")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's begin and end."""
    at = np.asarray(lists.offsets, np.int64)
    return np.asarray(lists.flatten(), np.int64), at - at[0]


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows by bucket. Each task sums its own rows first, so it sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, times = _flat(batch.column("bucket"))[0], _flat(batch.column("times"))[0]
            np.add.at(total, bucket, times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return found.select("bucket", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """For each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _weighed(by_bucket: list[int]):
    gain = np.array(by_bucket, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (bucket, at), (times, _) = _flat(batch.column("bucket")), _flat(batch.column("times"))
            total = np.r_[0, np.cumsum(gain[bucket] * times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(total[at[1:]] - total[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of sha256('seed:key'); null keys count as the text 'null'."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order from 1 on as ``name``: dealt by ranges, numbered within each, moved by what stands before.

    One shuffle; the counts that are added up are one number a range. rows has no columns place, part and before."""
    spread = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    before, now = {}, 0
    for p, n in sorted(spread.groupBy(part.alias("part")).count().collect()):
        before[p], now = now, now + n
    starts = rows.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return spread.withColumn("part", part).join(F.broadcast(starts), "part").withColumn(name, F.col("before") + within + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, grams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Weighs and draws the documents that look most like the target texts.

    One row for each row of docs: doc_id, n_words, n_features, weight, score and rank (1, 2, ... for the floor(percent N / 100) drawn
    of the N rows with ``least_words`` words or more, null for all others). Null and empty texts have no features and weight 0; rows of one
    id share their noise; ties go to smaller ids, rows without id last. Empty tables give no row; without target texts all buckets are
    weighed against none. Bucket counts (a number for each of ``buckets``) are all that comes to the driver."""
    found = written(features(docs, *grams, buckets), "features")
    corpus = dict(map(tuple, bucket_counts(found, buckets).collect()))
    wanted = dict(map(tuple, bucket_counts(features(target.withColumn("no", F.lit(0)), *grams, buckets, key="no"), buckets).collect()))
    weighed = found.mapInArrow(_weighed(gains(corpus, wanted, buckets)), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    drawn = found.where(fit).count() * percent // 100
    # rows with too few words come last, so all rows are numbered by one deal
    order = [F.when(fit, 0).otherwise(1).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    return ranked(scored, order, "rank").withColumn("rank", F.when(fit & (F.col("rank") <= drawn), F.col("rank")))
