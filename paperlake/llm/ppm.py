"""Language-model scores: prediction by partial matching over bytes, and a word-count base beside it.

The pretrained model is a trie of byte contexts up to ORDER bytes. Escape estimation is method C: in a
context with T occurrences of D distinct next bytes, a byte seen n times has n / (T + D) and the escape to
the next shorter context has D / (T + D). After an escape the bytes of the longer context are excluded.
The trie holds every gram of all training texts and stays in Spark tables: tasks that each hold the whole
contexts of their grams give every gram of the corpus its probability. The most frequent grams are sent to
all tasks, the others joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import SMALL, U, pieces, word_hashes, word_spans
from .shared import written

ORDER = 4
#: Bounds of what is sent to all tasks: frequent grams, and frequent words. Other grams and words are joined by a shuffle.
GRAMS, WORDS = 1 << 20, 1 << 19
#: Contexts up to SHORT bytes are sent to the tasks that make probabilities; they have 256 ** (SHORT + 1) grams at most.
SHORT = 2
_SLOTS, _TRIES = 22, 4


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte the number that its ORDER forerunners and itself make; before a text stand zero bytes."""
    place = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(at)), np.diff(at))
    padded = np.zeros(len(data) + ORDER * (len(at) - 1), U)
    padded[place] = data
    out = np.zeros(len(padded) - ORDER if len(padded) else 0, U)
    for k in range(ORDER + 1):
        out = (out << U(8)) | padded[k : k + len(out)]
    return out[place - ORDER]


class _Tally:
    """Counts of 64-bit keys, given out in parts so that memory stays bounded."""

    def __init__(self, most: int = 1 << 21) -> None:
        self.keys, self.counts, self.size, self.most = [], [], 0, most

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)

    def taken(self) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys or [np.zeros(0, U)]), np.concatenate(self.counts or [np.zeros(0, np.int64)])
        k, where = np.unique(keys, return_inverse=True)
        n = np.bincount(where, counts, len(k)).astype(np.int64)
        self.keys, self.counts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])


def _counted(keys_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for _, data, at in pieces(batches):
            tally.add(keys_of(SMALL[data], at))
            if tally.size > tally.most:
                yield tally.taken()
        yield tally.taken()

    return run


def _word_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    starts, ends, _ = word_spans(data, at)
    return word_hashes(data, starts, ends)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of (text, held_out); those of held-out texts have one bit more."""
    tally = _Tally()
    for part, data, at in pieces(batches):
        held = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
        tally.add(_codes(SMALL[data], at) | np.repeat(held.astype(U), np.diff(at)) << U(8 * (ORDER + 1)))
        if tally.size > tally.most:
            yield tally.taken()
    yield tally.taken()


def _summed(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct last k + 1 bytes of codes in order, and their counts."""
    keys, where = np.unique(codes & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return keys, np.bincount(where, counts, len(keys)).astype(np.int64)


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of x, or -1."""
    if not len(sorted_):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[i] == x, i, -1)


class Trie:
    """The contexts of all orders as sorted arrays.

    Orders up to SHORT are those of all training texts (short: grams of SHORT + 1 bytes and counts), the
    others those of codes, which must be all grams of the contexts of SHORT + 1 bytes that they belong to."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> None:
        tables = [_summed(*(short if k <= SHORT else (codes, counts)), k) for k in range(ORDER + 1)]
        self.grams, self.counts = [t[0] for t in tables], [t[1] for t in tables]
        self.contexts, self.total, self.distinct, self.rest, self.others = [], [], [], [], []
        for k in range(ORDER + 1):
            c, first = np.unique(self.grams[k] >> U(8), return_index=True)
            n = self.counts[k]
            self.contexts.append(c)
            self.total.append(np.add.reduceat(n, first) if len(c) else n)
            self.distinct.append(np.diff(np.append(first, len(n))))
            if k == 0 or not len(c):
                self.rest.append(np.zeros(len(c)))
                self.others.append(np.zeros(len(c)))
                continue
            # of the next shorter context: what is left without the bytes of this one
            shorter = np.searchsorted(self.contexts[k - 1], c & U((1 << 8 * (k - 1)) - 1))
            same = self.counts[k - 1][np.searchsorted(self.grams[k - 1], self.grams[k] & U((1 << 8 * k) - 1))]
            self.rest.append(self.total[k - 1][shorter] - np.add.reduceat(same, first))
            self.others.append(self.distinct[k - 1][shorter] - self.distinct[k])

    def walked(self, codes: np.ndarray) -> np.ndarray:
        """log10 of each last byte's probability after the bytes before it, from the longest context down."""
        out = np.zeros(len(codes))
        open_, above = np.arange(len(codes)), np.full(len(codes), -1)
        for k in range(ORDER, -1, -1):
            code = codes[open_]
            c = _find(self.contexts[k], (code >> U(8)) & U((1 << 8 * k) - 1))
            there = c >= 0
            fresh = above < 0
            up = np.maximum(above, 0)
            t, d = np.zeros(len(code)), np.zeros(len(code))
            t[there & fresh], d[there & fresh] = self.total[k][c[there & fresh]], self.distinct[k][c[there & fresh]]
            if k < ORDER:
                old = there & ~fresh
                t[old], d[old] = self.rest[k + 1][up[old]], self.others[k + 1][up[old]]
            g = _find(self.grams[k], code & U((1 << 8 * (k + 1)) - 1))
            hit = there & (g >= 0)
            out[open_[hit]] += np.log10(self.counts[k][g[hit]] / (t[hit] + d[hit]))
            miss = there & (g < 0) & (d > 0)
            out[open_[miss]] += np.log10(d[miss] / (t[miss] + d[miss]))
            above = np.where(there, c, -1)[~hit]
            open_ = open_[~hit]
        seen = int(self.distinct[0][0]) if len(self.distinct[0]) else 0
        out[open_] -= np.log10(max(1, 256 - seen))
        return out


class Frequent:
    """log10 probabilities of some grams in a hash table; grams that find no slot are in sorted arrays beside it."""

    def __init__(self, left: np.ndarray, worth: np.ndarray) -> None:
        self.keys = np.full(1 << _SLOTS, -1, np.int64).view(U)
        self.values = np.zeros(1 << _SLOTS, np.float32)
        for i in range(_TRIES):
            slot = self._slot(left, i)
            empty = np.flatnonzero(self.keys[slot] == U(2**64 - 1))
            _, one = np.unique(slot[empty], return_index=True)
            put = empty[one]
            self.keys[slot[put]], self.values[slot[put]] = left[put], worth[put]
            keep = np.ones(len(left), bool)
            keep[put] = False
            left, worth = left[keep], worth[keep]
        order = np.argsort(left)
        self.left, self.worth = left[order], worth[order]

    @staticmethod
    def _slot(codes: np.ndarray, i: int) -> np.ndarray:
        return ((codes * U(0x9E3779B97F4A7C15 + 2 * i * 0x1234567)) >> U(64 - _SLOTS)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 for grams that aren't held, and the places of these."""
        out = np.zeros(len(codes), np.float64)
        todo = np.arange(len(codes))
        for i in range(_TRIES):
            slot = self._slot(codes[todo], i)
            hit = self.keys[slot] == codes[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out, todo
        at = _find(self.left, codes[todo])
        out[todo[at >= 0]] = self.worth[at[at >= 0]]
        return out, todo[at < 0]


def _worths(short):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys, n = table.column("key").to_numpy().view(U), table.column("n").to_numpy()
        trie = Trie(keys[n > 0], n[n > 0], short.value)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(table.column("m").to_numpy()), pa.array(trie.walked(keys).astype(np.float32))], ["key", "m", "worth"])

    return run


def gram_worths(rows: DataFrame) -> DataFrame:
    """(key, m, worth) of every gram of rows (held_out, text): how often it occurs, and log10 of its last byte's
    probability after the others in the trie of all rows that aren't held out."""
    bit = 1 << 8 * (ORDER + 1)
    counts = rows.select("text", "held_out").mapInArrow(_gram_counts, "key long, n long")
    learned = F.sum(F.when(F.col("key") < bit, F.col("n")).otherwise(0))
    grams = counts.groupBy(F.col("key").bitwiseAND(F.lit(bit - 1)).alias("gram")).agg(learned.alias("n"), F.sum("n").alias("m"))
    grams = written(grams.withColumnRenamed("gram", "key"), "grams")
    last = F.col("key").bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    table = grams.where("n > 0").groupBy(last.alias("key")).agg(F.sum("n").alias("n")).toArrow()
    short = rows.sparkSession.sparkContext.broadcast((table.column("key").to_numpy().view(U), table.column("n").to_numpy()))
    # a context of SHORT + 1 bytes and all that is longer lie in one task; such a context has 256 ** (ORDER - SHORT) grams at most
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    return written(grams.repartition(context).mapInArrow(_worths(short), "key long, m long, worth float"), "worths")


def _least(worths: DataFrame) -> int:
    """The least number of occurrences for which the grams that have it number GRAMS at most."""
    level = F.floor(F.log2("m") * 8).cast("int")
    sizes = sorted(worths.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("kinds"), F.min("m").alias("least"), F.max("m").alias("most")).collect(), key=lambda r: -r["level"])
    least, kinds = sizes[0]["most"] + 1 if sizes else 1, 0
    for r in sizes:
        kinds += r["kinds"]
        if kinds > GRAMS:
            return least
        least = r["least"]
    return 1


def _scored(frequent, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (keys, counts) = frequent.value, common.value
        logs = np.log10(counts + 1.0)
        task, done = TaskContext.get().partitionId(), 0
        for part, data, at in pieces(batches):
            data = SMALL[data]
            codes = _codes(data, at)
            worth, others = model(codes)
            sums = np.concatenate([[0.0], np.cumsum(worth)])
            grams = pa.ListArray.from_arrays(np.searchsorted(others, at).astype(np.int32), pa.array(codes[others].view(np.int64)))
            starts, ends, first = word_spans(data, at)
            words = word_hashes(data, starts, ends)
            place = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0)) if len(keys) else np.zeros(len(words), np.int64)
            usual = keys[place] == words if len(keys) else np.zeros(len(words), bool)
            base = np.concatenate([[0.0], np.cumsum(np.where(usual, logs[place] if len(keys) else 0.0, 0.0))])
            known = np.concatenate([[0], np.cumsum(usual)])
            rare = np.concatenate([[0], np.cumsum(~usual)])
            lists = pa.ListArray.from_arrays(rare[first].astype(np.int32), pa.array(words[~usual].view(np.int64)))
            rows = np.arange(done, done + part.num_rows) + (task << 33)
            done += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), part.column(0), part.column(1), pa.array(np.diff(first) + 1), pa.array(np.diff(known[first])),
                    pa.array(np.diff(base[first])), pa.array(np.diff(sums[at])), lists, grams,
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "grams"],
            )

    return run


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row for each row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows for which ``held_out`` isn't true are learned from. A-Z count as a-z throughout. Tokens are the
    words and one end; base_score sums log10((c + 1) / (N + V + 1)); score is the trie's log10 probability of
    the text's bytes. Null texts are empty: one token, score 0. Repeated rows count each time; without
    training rows all bytes are alike. Words are told apart by 64-bit hashes. The words that make up
    1 / WORDS of all and the GRAMS most frequent grams are sent to all tasks, the others joined by a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    texts = rows.where("NOT held_out")
    spark = docs.sparkSession
    worths = gram_worths(rows)
    often = _least(worths)
    table = worths.where(F.col("m") >= often).select("key", "worth").toArrow()
    frequent = spark.sparkContext.broadcast(Frequent(table.column("key").to_numpy().view(U), table.column("worth").to_numpy()))
    words = written(texts.select("text").mapInArrow(_counted(_word_keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("c")), "words")
    ends = texts.agg(F.count(F.lit(1))).first()[0]
    one = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = (one["n"] or 0) + ends, one["v"] + (ends > 0)
    least = max(1, -(-total // WORDS))
    table = words.where(F.col("c") >= least).toArrow()
    keys = table.column("key").to_numpy().view(U)
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], table.column("c").to_numpy()[order].astype(float)))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, grams array<long>"
    scored = written(rows.mapInArrow(_scored(frequent, common), schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("n"))
    rare = rare.join(words.where(F.col("c") < least), "key")
    more = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"))
    log_all, log_end = float(np.log10(total + kinds + 1)), float(np.log10(ends + 1))
    zero = F.lit(0)
    scored, score = scored.drop("rare"), F.col("score")
    if often > 1:  # else all grams were sent
        seldom = scored.select("row", F.explode("grams").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("n"))
        seldom = seldom.join(worths.where(F.col("m") < often).select("key", "worth"), "key")
        scored = scored.join(seldom.groupBy("row").agg(F.sum(F.col("n") * F.col("worth").cast("double")).alias("more_score")), "row", "left")
        score = score + F.coalesce("more_score", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(log_end) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        score.alias("score"),
    )
