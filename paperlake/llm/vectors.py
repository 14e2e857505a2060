"""Exact and approximate search among vectors: each task indexes some vectors and answers a bounded block of queries.

Vectors are dealt into parts of bounded size once, by their row. Queries are answered in blocks of at most QUERIES,
which are sent to all tasks; the few best of each part meet in a window by query. So vectors are shuffled once,
whatever the number of queries, and a block of queries is never larger than its bound.

Exact (inner products of whole numbers): an impact-ordered index. The entries of a part are posting lists by
quantised impact, the place of the highest bit of the absolute value, and by dimension. Lists are
processed score at a time, in descending impact, each adding its share to the scores of the vectors in it. After
the lists of one impact, the norms of what is still unread bound every score; it stops when the proof leaves
few possible members, which are rescored exactly.

Approximate (cosine): collision counting. The index keeps vectors sorted along LINES single projections.
A query widens windows around its own projections by virtual rehashing, counts how often a vector falls
into them, and verifies vectors that collide on enough lines, until its best ones can't be expected to
improve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

#: Vectors of one index, queries of one block, and queries whose scores are added up together.
VECTORS, QUERIES, TOGETHER = 8192, 4096, 32
#: Approximate search: lines, the share of them on which a vector must collide to be verified,
#: the first window's half width (in standard deviations of a projection), its growth, and the
#: standard deviations that a better vector would have to be missed by.
LINES, COLLIDE, FIRST, GROWTH, SURE = 96, 0.5, 0.35, 1.25, 1.0

#: (rows, ids, vectors) of some vectors of one length.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]
Found = list[tuple[int, int, int, float]]


def _parts(table: pa.Table) -> Iterator[Part]:
    """The vectors of a table (row, vec_id, vector), those of each length apart."""
    rows, ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
    column = table.column("vector").combine_chunks()
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        yield rows[own], ids[own], flat[begin[own, None] + np.arange(n)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


def postings(values: np.ndarray) -> list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]]:
    """By descending impact: the lists (dimension, places, values) of that impact, and the norms of what is unread after them.

    An entry's impact is the place of its highest bit."""
    level = np.frexp(np.abs(values))[1]
    level[values == 0] = 0
    out = []
    for impact in range(int(level.max(initial=0)), 0, -1):
        dimension, place = np.nonzero(level.T == impact)
        cut = np.flatnonzero(np.diff(dimension)) + 1
        lists = [(int(d[0]), p, values[p, d[0]]) for d, p in zip(np.split(dimension, cut), np.split(place, cut), strict=True) if len(d)]
        if lists:
            out.append((lists, np.sqrt((np.where(level < impact, values, 0.0) ** 2).sum(1))))
    return out


def _exact(part: Part, asked: Part, k: int) -> Found:
    rows, ids, base = part
    out: Found = []
    index = postings(base)
    enough = max(64, len(ids) // 64)
    for i in range(0, len(asked[0]), TOGETHER):
        query_rows, query_ids, queries = (x[i : i + TOGETHER] for x in asked)
        norm = np.sqrt((queries**2).sum(1))
        score = np.zeros((len(ids), len(queries)))
        own = rows[:, None] == query_rows[None, :]
        possible = ~own
        for lists, rest in index:
            for dimension, place, value in lists:
                score[place] += value[:, None] * queries[None, :, dimension]
            # proof: what is unread changes no score by more than the norms of query and rest; sums of whole numbers are exact
            bound = rest[:, None] * norm[None, :]
            lower = np.where(own, -np.inf, score - bound)
            m = min(k, len(ids)) - 1
            cut = -np.partition(-lower, m, axis=0)[m]
            possible = (score + bound >= cut[None, :]) & ~own
            if possible.sum(0).max(initial=0) <= enough:
                break
        for j in range(len(queries)):
            near = np.flatnonzero(possible[:, j])
            exact = base[near] @ queries[j]
            out += [(int(query_rows[j]), int(query_ids[j]), int(ids[near[p]]), int(exact[p])) for p in _best(exact, ids[near], k)]
    return out


def _approximate(part: Part, asked: Part, k: int, seed: int = 5) -> Found:
    rows, ids, base = part
    out: Found = []
    lines = np.random.default_rng(seed).standard_normal((base.shape[1], LINES))
    unit = base / np.sqrt((base**2).sum(1))[:, None]
    at = unit @ lines
    order = np.argsort(at, 0).astype(np.int32).T
    # all lines in one sorted array: projections are far smaller than the steps between lines
    step = 1e3 * np.arange(LINES)
    flat = (np.take_along_axis(at.T, order, 1) + step[:, None]).ravel()
    order = np.ascontiguousarray(order).ravel()
    need = int(np.ceil(COLLIDE * LINES))
    norms = np.sqrt((asked[2] ** 2).sum(1))
    for me, my_id, query, norm in zip(*asked, norms, strict=True):
        direction = query / norm
        place = direction @ lines + step
        counts, checked = np.zeros(len(ids), np.int16), rows == me
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        width, low, high = FIRST, None, None
        while True:
            new_low, new_high = np.searchsorted(flat, place - width), np.searchsorted(flat, place + width, "right")
            if low is None:
                more = [order[a:b] for a, b in zip(new_low.tolist(), new_high.tolist(), strict=True)]
            else:
                more = [order[a:b] for a, b in zip(new_low.tolist(), low.tolist(), strict=True)] + [order[a:b] for a, b in zip(high.tolist(), new_high.tolist(), strict=True)]
            low, high = new_low, new_high
            counts += np.bincount(np.concatenate(more), minlength=len(ids)).astype(np.int16)
            fresh = np.flatnonzero((counts >= need) & ~checked)
            checked[fresh] = True
            found, cosines = np.concatenate([found, fresh]), np.concatenate([cosines, unit[fresh] @ direction])
            if checked.all():
                break
            if len(found) >= k:
                # a vector at distance d collides on a line with probability P(|d g| <= width)
                d = np.sqrt(max(0.0, 2 - 2 * np.partition(cosines, len(cosines) - k)[len(cosines) - k]))
                if width >= d * SURE:
                    break
            width *= GROWTH
        if len(found) > k:
            # rounding moves a cosine by far less than that, so the best k and their ties are among these
            found = found[cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k] - 1e-9]
        exact = (base[found] * query).sum(1) / (np.sqrt((base[found] ** 2).sum(1)) * norm)
        out += [(int(me), int(my_id), int(ids[found[p]]), float(exact[p])) for p in _best(exact, ids[found], k)]
    return out


def _search(asked, answer: Callable[[Part, Part, int], Found], k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {q[2].shape[1]: q for q in _parts(asked.value)}

        def answers(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = [r for part in _parts(pa.Table.from_batches(held)) if part[2].shape[1] in queries for r in answer(part, queries[part[2].shape[1]], k)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), kind)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_row", "query_id", "vec_id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= VECTORS:
                yield answers(held)
                held = []
        if held:
            yield answers(held)

    return run


def _found(usable: DataFrame, is_query: Column, k: int, answer: Callable[[Part, Part, int], Found], kind: tuple[str, pa.DataType]) -> DataFrame:
    """The best k of all parts for each query row; rows that repeat a vector or an id are rows of their own."""
    spark = usable.sparkSession
    bounded_batches(spark)
    base = written(usable.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "vector"), "vectors")
    asked = base.where(is_query)
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    dealt = base.repartition(max(1, -(-base.count() // VECTORS)), "row")
    dealt = dealt if blocks == 1 else written(dealt, "dealt")
    schema, out = f"query_row long, query_id long, vec_id long, score {kind[0]}", None
    for i in range(blocks):
        block = spark.sparkContext.broadcast(asked.where(F.col("block") == i).drop("block").toArrow())  # QUERIES rows or so
        found = dealt.mapInArrow(_search(block, answer, k, kind[1]), schema)
        found = found if blocks == 1 else written(found, "found")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) whose vector is there and holds finite numbers only."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"), (v.isNotNull() & ~bad & (F.size(v) > 0)).alias("fit"))
    return rows.where("fit AND vec_id IS NOT NULL").select("vec_id", "vector")


def top_inner(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest inner products of floor(256 x) for each query row among all rows but its own: query_id, rank, vec_id, score.

    vectors: (vec_id, embedding); is_query: a condition on vec_id. Vectors that are null, empty or hold
    null or non-finite components, and null ids, take no part; with fewer candidates all are given; an
    empty table gives no rows. Rows that repeat an id are candidates and queries of their own. Only
    vectors of the query's length are its candidates."""
    whole = _usable(vectors).withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256).cast("double")))
    return _found(whole, is_query, k, _exact, ("long", pa.int64()))


def nearest_cosine(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k nearest by cosine that collision counting finds for each query row among all rows but its own.

    As top_inner; zero vectors take no part either. score is the cosine in double precision."""
    usable = _usable(vectors).where(F.exists("vector", lambda x: x != 0))
    return _found(usable, is_query, k, _approximate, ("double", pa.float64()))
