"""Search over chunks: nearest vectors, ranked words, their fusion, and names of what is found."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to the tasks at a time; more are searched in further passes.
BLOCK = 1024
#: Hits, and how many times that each part searches; hits of one parent, characters of a hit, BM25's and the fusion's constants.
TOP, NEIGHBOURS, FUSED, PER_PARENT, MOST_CHARS, K1, B, FUSION = 15, 8, 5, 7, 5000, 1.2, 0.75, 60
WORD = re.compile("[a-z]+")


class _Best:
    """The k best (score, id) of each query; ties to smaller ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = [np.zeros(0)] * queries
        self.id = [np.zeros(0, np.int64)] * queries
        self.cut = np.full(queries, -np.inf)  # what a further hit must reach

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        fit = score >= self.cut[q]
        if not fit.any():
            return
        score, ids = score[fit], ids[fit]
        score, ids = np.r_[self.score[q], score], np.r_[self.id[q], ids]
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]
        if len(order) == self.k:
            self.cut[q] = self.score[q][-1]

    def rows(self, names: list) -> Iterator[pa.RecordBatch]:
        for q, name in enumerate(names):
            if len(self.id[q]):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(self.id[q]), pa.int64()), pa.array(self.id[q]), pa.array(self.score[q])], ["query_id", "id", "score"])


_HITS = "query_id long, id long, score double"


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The rows of queries in blocks, a block at a time on the driver."""
    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def _top(found: list[DataFrame], k: int, empty: DataFrame) -> DataFrame:
    out = found[0] if found else empty
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): each query's k chunks with the highest cosine, ties to smaller chunk ids; exact.

    queries: (query_id, vector), chunks: (chunk_id, vector). Blocks of queries go to all tasks; a task compares them with its batches of chunks and sends its own k best of each
    query only. Vectors that are null, of another length than the query's, zero or not finite take no part."""

    def against(block: list):
        names, vectors = [r.query_id for r in block], [np.array([np.nan if x is None else x for x in r.vector], float) for r in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(names), k)
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and v and None not in v]
                for size in {len(v) for _, v in rows}:
                    ids, matrix = np.array([i for i, v in rows if len(v) == size]), np.array([v for _, v in rows if len(v) == size], float)
                    square = (matrix * matrix).sum(1)
                    fit = np.isfinite(square) & (square > 0)
                    ids, matrix, square = ids[fit], matrix[fit], square[fit]
                    asked = [q for q, v in enumerate(vectors) if len(v) == size and np.isfinite(v).all() and v.any()]
                    if asked and len(ids):
                        own = np.array([vectors[q] for q in asked])
                        cosine = (own @ matrix.T) / np.sqrt((own * own).sum(1)[:, None] * square)
                        for q, score in zip(asked, cosine, strict=True):
                            best.add(q, score, ids)
            yield from best.rows(names)

        return run

    rows = chunks.select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>"))
    found = [rows.mapInArrow(against(block), _HITS) for block in _blocks(queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector")))]
    return _top(found, k, rows.limit(0).selectExpr("chunk_id AS query_id", "chunk_id AS id", "0D AS score")).select("query_id", "rank", F.col("id").alias("chunk_id"), "score")


def best_by_words(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's k texts by BM25 over its distinct words (runs of a-z, lower-cased), scores to six places, ties to smaller ids.

    queries: (query_id, text), docs: (doc_id, text). A pass counts the texts that hold each wanted word; then blocks of queries go to all tasks, which score their texts whole
    and send their own k best of each query only, so neither words nor pairs of query and text are shuffled. Texts without a query's words aren't listed; null texts are empty."""
    lower = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    texts = lower(docs, "doc_id")

    def totals(wanted: set[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = size = 0
            df: Counter = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    words = WORD.findall(text)
                    n, size = n + 1, size + len(words)
                    df.update(wanted.intersection(words))
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([size] + [0] * len(df), pa.int64())], ["word", "n", "size"])

        return run

    def scored(asked: list[tuple[int, set[str]]], idf: dict[str, float], mean: float):
        postings: dict[str, list[int]] = {}
        for q, (_, words) in enumerate(asked):
            for w in words:
                postings.setdefault(w, []).append(q)
        rows = {w: (np.array(qs), idf[w]) for w, qs in postings.items() if w in idf}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(asked), k)
            total = np.zeros(len(asked))
            for batch in batches:
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = WORD.findall(text)
                    norm = K1 * (1 - B + B * len(words) / (mean or 1))
                    total[:] = 0
                    for w, tf in Counter(words).items():
                        if w in rows:
                            qs, weight = rows[w]
                            total[qs] += weight * tf * (K1 + 1) / (tf + norm)
                    points = np.round(total, 6)
                    for q in np.flatnonzero((total > 0) & (points >= best.cut)):
                        best.add(q, points[q : q + 1], np.array([i]))
            yield from best.rows([name for name, _ in asked])

        return run

    found = []
    for block in _blocks(lower(queries, "query_id")):
        asked = [(r.id, set(WORD.findall(r.text))) for r in block]
        wanted = set().union(*(w for _, w in asked))
        counts = texts.select("text").mapInArrow(totals(wanted), "word string, n long, size long").groupBy("word").agg(F.sum("n"), F.sum("size")).collect()  # a row a wanted word
        df, (n, size) = {w: c for w, c, _ in counts if w is not None}, next(((c, s) for w, c, s in counts if w is None), (0, 0))
        idf = {w: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for w, c in df.items()}
        found.append(texts.mapInArrow(scored(asked, idf, size / n if n else 1), _HITS))
    return _top(found, k, texts.limit(0).selectExpr("id AS query_id", "id", "0D AS score")).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def derived_filename(title: Column, filepath: Column, parent: Column) -> Column:
    """A title that isn't blank; else the last segment of a path that isn't; else that of the parent URL's path, decoded, if there is one; else a stand-in."""
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"\s", "") == "", F.lit(True))
    path = F.regexp_extract(parent, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_replace(F.substring_index(path, "/", -1), ";.*$", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(last, r"\+", "%2B")), last)
    return F.when(~blank(title), title).when(~blank(filepath), F.substring_index(filepath, "/", -1)).when(path.contains("/") & (decoded != ""), decoded).otherwise("Unknown Document")


def hybrid_search(queries: DataFrame, chunks: DataFrame, top: int = TOP) -> DataFrame:
    """Each query's hits by words and by vectors together: (query_id, rank, chunk_id, parent, filename, content).

    queries: (query_id, text, vector), chunks: (chunk_id, parent_id, title, filepath, content, vector). NEIGHBOURS times ``top`` nearest vectors and FUSED times as many texts are
    fused by the sum of 1 / (60 + rank), ties to smaller ids; of the FUSED times ``top`` best the first ``top`` with content count, at most PER_PARENT of a parent (chunks without one are
    their own), whose name is that of its best chunk. Contents are cut to MOST_CHARS characters, as the search returns them."""
    near = nearest(queries.select("query_id", "vector"), chunks.select("chunk_id", "vector"), top * NEIGHBOURS)
    said = best_by_words(queries.select("query_id", "text"), chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), top * FUSED)
    ranks = near.select("query_id", "chunk_id", F.col("rank").alias("r1")).join(said.select("query_id", F.col("doc_id").alias("chunk_id"), F.col("rank").alias("r2")), ["query_id", "chunk_id"], "full")
    points = F.coalesce(1.0 / (F.lit(FUSION) + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (F.lit(FUSION) + F.col("r2")), F.lit(0.0))
    by = Window.partitionBy("query_id").orderBy(F.col("points").desc(), "chunk_id")
    fused = ranks.withColumn("points", points).withColumn("place", F.row_number().over(by)).where(F.col("place") <= top * FUSED)
    facts = chunks.select("chunk_id", F.when(F.col("parent_id") != "", F.col("parent_id")).otherwise(F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))).alias("parent"),
                          derived_filename(F.col("title"), F.col("filepath"), F.col("parent_id")).alias("own_name"), F.substring("content", 1, MOST_CHARS).alias("content"))
    hits = fused.join(facts, "chunk_id")
    family = Window.partitionBy("query_id", "parent").orderBy("place")
    hits = hits.withColumn("filename", F.first("own_name").over(family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hits = hits.where("content <> ''").withColumn("nth", F.row_number().over(family)).where(F.col("nth") <= PER_PARENT)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= top)
    return hits.select("query_id", "rank", "chunk_id", "parent", "filename", "content")
