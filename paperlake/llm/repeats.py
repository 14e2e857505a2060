"""Suffix-array de-duplication: bytes covered by a long string that also starts earlier are removed.

Suffixes are sampled so that equal strings are sampled alike: every LENGTH-byte string holds a sampled
place, the one whose GRAM bytes have the smallest hash of all in it. Sampled places are told apart by
their whole surroundings, as far as a LENGTH-byte string around them reaches. A place whose surroundings
also stand earlier is covered by them. The first place of each surroundings is compared with the other
ones of its gram: their suffixes, and their reversed left sides, are put in order by a deep-shallow sort;
the common prefixes of neighbours then tell, for each offset, which strings are equal and which is first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _BYTE, U, mixed, pieces
from .deep_shallow import neighbours_common, sorted_order
from .shared import written

LENGTH, GRAM = 100, 24
LEFT = LENGTH - GRAM
_BASE = 0x5DEECE66D1234567 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 21) + 1
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, U(b))
            steps[0] = U(1)
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class _Hashed:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def sampled(data: np.ndarray, at: np.ndarray, hashed: _Hashed) -> tuple[np.ndarray, np.ndarray]:
    """The sampled places, in order, and the text of each."""
    n, w = len(data), LENGTH - GRAM + 1
    windows = n - LENGTH + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.arange(n - GRAM + 1)
    value = (hashed(i, i + GRAM) & U(0xFFFFFFFF00000000)) | i.astype(U)
    rows = -(-len(value) // w)
    grid = np.full(rows * w, U(2**64 - 1))
    grid[: len(value)] = value
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    size = np.diff(at)
    inside = np.zeros(n + 1, np.int64)
    long = size >= LENGTH
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - LENGTH + 1, -1)
    place = (least[np.cumsum(inside[:windows]) > 0] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(place):
        return place, place
    place = place[np.append(True, np.diff(place) != 0)]
    return place, np.searchsorted(at, place, "right") - 1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, gram, around, doc_id, text_hash, place, known) of the sampled places.

    Of places with the same surroundings in one part of a batch only the first has known = false and goes
    to the others of its gram; the rest are covered already. So a passage that many texts share makes
    few rows of one gram."""
    for part, data, at in pieces(batches):
        hashed = _Hashed(data)
        place, owner = sampled(data, at, hashed)
        if not len(place):
            continue
        start, end = np.maximum(at[owner], place - LEFT), np.minimum(at[owner + 1], place + LENGTH)
        gram = hashed(place, place + GRAM)
        around = mixed(hashed(start, end) + (place - start).astype(U) * U(0x9E3779B97F4A7C15) + (end - place).astype(U))
        ids, texts = part.column(0).to_numpy(), part.column(1).to_numpy()
        order = np.lexsort((place - at[owner], texts[owner], ids[owner], around))
        known = np.zeros(len(place), bool)
        known[order[1:]] = around[order[1:]] == around[order[:-1]]
        known[order[1:]] &= gram[order[1:]] == gram[order[:-1]]
        # two rows that repeat an id and a text are one text
        same = known[order[1:]] & (ids[owner[order[1:]]] == ids[owner[order[:-1]]]) & (texts[owner[order[1:]]] == texts[owner[order[:-1]]]) & (place[order[1:]] - at[owner[order[1:]]] == place[order[:-1]] - at[owner[order[:-1]]])
        keep = np.ones(len(place), bool)
        keep[order[1:]] = ~same
        # what is covered already only passes through: it is spread by its own place
        route = np.where(known, mixed(around + ids[owner].astype(U) * U(0x9E3779B97F4A7C15) + place.astype(U)), gram)
        columns = [route.view(np.int64), gram.view(np.int64), around.view(np.int64), ids[owner], texts[owner], (place - at[owner]).astype(np.int32), known]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["route", "gram", "around", "doc_id", "text_hash", "place", "known"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all rows of some grams: places that are covered whole (gram null), and first places to be compared with others."""
    table = _gathered(batches)
    if table is None:
        return
    col = {n: table.column(n).to_numpy() for n in table.schema.names}
    names = ["doc_id", "text_hash", "place"]
    done = col["known"]
    order = np.lexsort((col["place"], col["text_hash"], col["doc_id"], col["around"], col["gram"]))
    order = order[~done[order]]
    g, a = col["gram"][order], col["around"][order]
    new_gram, first = np.ones(len(order), bool), np.ones(len(order), bool)
    new_gram[1:] = g[1:] != g[:-1]
    first[1:] = new_gram[1:] | (a[1:] != a[:-1])
    again = first.copy()
    if len(order):
        # a repeated row of the very same place isn't a repeat
        same = np.zeros(len(order), bool)
        same[1:] = ~first[1:]
        for n in names:
            same[1:] &= col[n][order[1:]] == col[n][order[:-1]]
        again |= same
        of = np.cumsum(new_gram) - 1
        several = np.bincount(of, first)[of] > 1
    else:
        several = first
    whole = np.concatenate([np.flatnonzero(done), order[~again]])
    edge = order[first & several]
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(np.concatenate([col[n][whole], col[n][edge]])) for n in names), pa.array(np.concatenate([col["gram"][whole], col["gram"][edge]]), mask=np.arange(len(whole) + len(edge)) < len(whole))],
        [*names, "gram"],
    )


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the places of each text: rows (gram, doc_id, text_hash, place, left, right, bytes)."""
    reach = np.arange(-LEFT, LENGTH)
    for part, data, at in pieces(batches):
        places, grams = part.column("places"), part.column("grams")
        n = np.diff(places.offsets.to_numpy())
        place = places.flatten().to_numpy()
        owner = np.repeat(np.arange(part.num_rows), n)
        x = at[owner] + place
        for i in range(0, len(x), 20_000):
            s = slice(i, i + 20_000)
            take = x[s, None] + reach
            here = (take >= at[owner[s], None]) & (take < at[owner[s] + 1, None])
            block = np.where(here, data[np.clip(take, 0, len(data) - 1)], 0).astype(np.uint8)
            size = LEFT + LENGTH
            cuts = np.arange(0, (len(block) + 1) * size, size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    grams.flatten().slice(i, len(block)), pa.array(part.column("doc_id").to_numpy()[owner[s]]), pa.array(part.column("text_hash").to_numpy()[owner[s]]), pa.array(place[s]),
                    pa.array(here[:, :LEFT].sum(1).astype(np.int32)), pa.array(here[:, LEFT:].sum(1).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(cuts), pa.py_buffer(block)]),
                ],
                ["gram", "doc_id", "text_hash", "place", "left", "right", "around"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all first places of some grams: rows (doc_id, text_hash, start, end) of what earlier strings cover."""
    table = _gathered(batches)
    if table is None:
        return
    col = {n: table.column(n).to_numpy() for n in ("doc_id", "text_hash", "place", "left", "right")}
    by = np.lexsort((table.column("gram").to_numpy(), col["place"], col["text_hash"], col["doc_id"]))
    new = np.ones(len(by), bool)  # rows that repeat an id and a text give the same places
    new[1:] = np.logical_or.reduce([col[n][by[1:]] != col[n][by[:-1]] for n in ("doc_id", "text_hash", "place")])
    by = by[new]
    col = {n: v[by] for n, v in col.items()}
    around = np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint8).reshape(-1, LEFT + LENGTH)[by]
    right, left = around[:, LEFT:], np.ascontiguousarray(around[:, LEFT - 1 :: -1])
    ranks = []
    for side in (right, left):
        order = sorted_order(side)
        ranks.append((order, neighbours_common(side, order)))
    nearest, farthest = np.full(len(by), LENGTH), np.full(len(by), -1)
    ids = np.empty((2, len(by)), np.int64)
    for back in range(LEFT + 1):
        for i, (order, common) in enumerate(ranks):
            ids[i, order] = np.cumsum(common < (LENGTH - back, back)[i])
        own = np.flatnonzero((col["left"] >= back) & (col["right"] >= LENGTH - back))
        _, first, where = np.unique((ids[0, own] << 32) | ids[1, own], return_index=True, return_inverse=True)
        late = own[first[where] != np.arange(len(own))]
        nearest[late] = np.minimum(nearest[late], back)
        farthest[late] = back
    hit = np.flatnonzero(farthest >= 0)
    # strings of one place overlap, so together they are one run
    start, end = col["place"][hit] - farthest[hit], col["place"][hit] - nearest[hit] + LENGTH
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col["doc_id"][hit], col["text_hash"][hit], start.astype(np.int32), end.astype(np.int32))], ["doc_id", "text_hash", "start", "end"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, at in pieces(batches):
        places, starts, ends = (part.column(n).to_pylist() for n in ("places", "starts", "ends"))
        out = []
        for d in range(part.num_rows):
            own = data[at[d] : at[d + 1]]
            size = len(own)
            runs = np.zeros(size + 1, np.int64)
            x = np.array(places[d] or [], np.int64)
            a, b = np.maximum(0, x - LEFT), np.minimum(size, x + LENGTH)
            a, b = a[b - a >= LENGTH], b[b - a >= LENGTH]
            a, b = np.concatenate([a, np.array(starts[d] or [], np.int64)]), np.concatenate([b, np.array(ends[d] or [], np.int64)])
            np.add.at(runs, a, 1)
            np.add.at(runs, b, -1)
            gone = np.cumsum(runs[:size]) > 0
            n = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            out.append((size, n, spans, hashlib.sha256(own[~gone].tobytes() if n else own.tobytes()).hexdigest()))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_bytes, n_removed, n_spans and kept_sha256.

    Null texts are empty. Texts with one id are ordered by a hash; rows that repeat both id and text are
    judged as one text. Rows whose id is null come before all others. Strings never cross texts and are judged on the
    input. Other columns aren't read; an empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.hash(text).alias("text_hash"), text.alias("text"))
    schema = "route long, gram long, around long, doc_id long, text_hash int, place int, known boolean"
    places = rows.mapInArrow(_places, schema).repartition("route")
    places = written(places.mapInArrow(_sorted_out, "doc_id long, text_hash int, place int, gram long"), "places")
    key = ["doc_id", "text_hash"]

    edges = places.where("gram IS NOT NULL").groupBy(*key).agg(F.collect_list(F.struct("place", "gram")).alias("e"))
    edges = edges.select(*key, F.col("e.place").alias("places"), F.col("e.gram").alias("grams"))
    schema = "gram long, doc_id long, text_hash int, place int, left int, right int, around binary"
    around = rows.join(edges, key)
    around = around.select(*key, "places", "grams", "text").mapInArrow(_surroundings, schema).repartition("gram")
    covered = around.mapInArrow(_compared, "doc_id long, text_hash int, start int, end int")

    covered = covered.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    whole = places.where("gram IS NULL").groupBy(*key).agg(F.collect_list("place").alias("places"))
    out = rows.join(whole, key, "left").join(covered, key, "left").select(*key, "places", "starts", "ends", "text")
    out = out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))
