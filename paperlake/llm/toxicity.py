"""Toxicity by compression distance: how much shorter windows of a text get with a toxic dictionary.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic texts add to it.
Each window of a text (some words, about WINDOW bytes) is compressed with the ordinary one alone and
with both; the bytes saved beyond a threshold add up to the text's evidence. It counts against what
as many windows of clean texts give by chance, so that the decision doesn't depend on a text's length. All
thresholds are calibrated on labelled texts that the dictionaries haven't seen, long ones too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import SMALL, pieces, word_spans
from .shared import bounded_batches

#: Bytes of a window (whole words), of each dictionary, and zstandard's level.
WINDOW, TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 64, 4096, 32768, 12
#: A string of GRAM bytes speaks for toxicity if at least this share of the toxic texts has it.
#: The outer bytes of a run of such strings are the words around it.
SHARE, GRAM, MARGIN = 0.01, 5, 2
#: The fit reads at most so many labelled texts of each label. Longer ones than so many characters are only calibrated on.
TOXIC_TEXTS, ORDINARY_TEXTS, LONGEST = 3000, 6000, 10_000
#: Thresholds that the calibration tries: of a window's bytes, of a text's evidence, and standard deviations of chance.
#: Clean texts are strung together by so many to see what chance makes of long ones.
LEASTS, CUTS, DEVIATIONS, STRUNG = range(1, 12), (0.5, 1.5, 2.5, 3.5, 5.5, 7.5, 10.5), (0.0, 1.0, 2.0, 3.0, 4.0), (1, 5, 20, 60)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    window_gain: int
    text_gain: float
    #: Evidence that a window of clean texts gives by chance: its mean, and the deviations allowed for n windows by sqrt(n).
    chance: float = 0.0
    spread: float = 0.0


def _windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows, cut before words, and for each text the index of its first window."""
    starts, ends, first = word_spans(data, at)
    if not len(starts):
        return starts, ends, np.zeros(len(at), np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    cell = (starts - at[owner]) // WINDOW
    new = np.ones(len(starts), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    return starts[begin], ends[last], np.searchsorted(owner[begin], np.arange(len(at)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held) if content else zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)


class _Gains:
    """Bytes that the toxic dictionary saves, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        # the nearer part of a dictionary is its end: the ordinary part is as far away in both
        self.with_toxic, self.without = _compressor(toxic + ordinary).compress, _compressor(ordinary).compress

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gain of each window, and for each text the index of its first window."""
        data = SMALL[data]
        raw = data.tobytes()
        starts, ends, first = _windows(data, at)
        one, two = self.without, self.with_toxic
        windows = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array([len(one(w)) - len(two(w)) for w in windows], np.int64), first


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; of too few samples, the samples themselves."""
    try:
        trained = zstandard.train_dictionary(size, samples, d=6, k=24, level=LEVEL).as_bytes()
        return trained[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _grams(texts: list[str]) -> tuple[np.ndarray, bytes]:
    """The grams of GRAM bytes of all texts, and the lower-case bytes themselves; texts are set apart by line ends."""
    raw = b"\n".join(t.lower().encode() for t in texts)
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(0, len(data) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out, raw


def fit(docs: DataFrame, labels: DataFrame, keep: str = "true") -> Model:
    """The model of the labelled texts that ``keep`` (an SQL condition on doc_id) leaves.

    docs: (doc_id, text); labels: (doc_id, toxic). A sample bounded by TOXIC_TEXTS, ORDINARY_TEXTS and
    LONGEST, drawn by a hash of doc_id, comes to the driver; of its longer texts only sums do. Without any
    toxic texts nothing is toxic."""
    bounded_batches(docs.sparkSession)
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [marks.where(F.col("toxic") == t).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(n) for t, n in ((1, TOXIC_TEXTS), (0, ORDINARY_TEXTS))]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # bounded by the two limits
    texts = docs.select("doc_id", "text").where("length(text) > 0").join(sample, "doc_id").select("doc_id", "text", "toxic")
    rows = texts.where(F.length("text") <= LONGEST).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    toxic, plain = ([r["text"] for r in rows if r["toxic"] == t] for t in (1, 0))
    toxic, plain = list(dict.fromkeys(toxic)), list(dict.fromkeys(plain))
    extra, ordinary = _dictionaries(toxic, plain)
    long = texts.where(F.length("text") > LONGEST).mapInArrow(_long_sums(extra, ordinary), "toxic int, sums array<long>").collect()
    gains = _Gains(extra, ordinary)
    bad, good = (np.concatenate([_sums(*gains(*_packed(t[1::2]))), np.array([r["sums"] for r in long if r["toxic"] == k], np.int64).reshape(-1, 1 + len(LEASTS))]) for k, t in ((1, toxic), (0, plain)))
    return _calibrated(extra, ordinary, bad, good)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number of windows, and for each of LEASTS the sum of what they gain beyond it."""
    columns = np.stack([np.ones(len(values), np.int64), *(np.maximum(values - least, 0) for least in LEASTS)], 1)
    total = np.concatenate([np.zeros((1, columns.shape[1]), np.int64), np.cumsum(columns, 0)])
    return total[first[1:]] - total[first[:-1]]


def _long_sums(extra: bytes, ordinary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(extra, ordinary)
        for part, data, at in pieces(batches):
            sums = _sums(*gains(data, at)).tolist()
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("toxic")), pa.array(sums, pa.list_(pa.int64()))], ["toxic", "sums"])

    return run


def _dictionaries(toxic: list[str], plain: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, from every other text."""
    ordinary = _dictionary([t.lower().encode() for t in plain[::2]], ORDINARY_BYTES)
    usual = set(np.unique(_grams(plain[::2])[0]).tolist())
    # what toxic texts add: strings of grams that several of them have and none of the ordinary texts; of near copies one counts
    counts: Counter[int] = Counter()
    for t in toxic[::2]:
        new = set(_grams([t])[0].tolist()) - usual
        if sum(x in counts for x in new) <= max(60, len(new) // 2):
            counts.update(new)
    least = max(2, round(SHARE * len(toxic) / 2))
    telling = np.array(sorted(x for x, n in counts.items() if n >= least), np.uint64)
    runs: Counter[bytes] = Counter()
    for t in toxic[::2]:
        grams, raw = _grams([t])
        hit = np.flatnonzero(np.isin(grams, telling))
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []:
            runs[raw[run[0] + MARGIN : run[-1] + GRAM - MARGIN]] += 1
    # the most frequent strings stand nearest to the ordinary part, as in zstandard's own dictionaries
    extra = b"".join(reversed([w for w, n in runs.most_common() if n >= least and len(w) >= GRAM - 1]))[-TOXIC_BYTES:]
    return extra, ordinary


def _calibrated(extra: bytes, ordinary: bytes, bad: np.ndarray, good: np.ndarray) -> Model:
    """The thresholds of the best F measure over toxic and clean texts (_sums); clean ones count at the length at which most are called toxic."""
    if not len(bad):
        return Model(extra, ordinary, LEASTS[0], float("inf"))
    lengths = [np.stack([g.sum(0) for g in np.split(good[: len(good) // k * k], len(good) // k)]) for k in STRUNG if len(good) >= k]
    best, model = (-1.0, 0.0), None
    for column, least in enumerate(LEASTS, 1):
        n = max(1, int(good[:, 0].sum()))
        chance = float(good[:, column].sum()) / n
        # of whole texts: windows of one text aren't independent
        deviation = float(np.sqrt(((good[:, column] - chance * good[:, 0]) ** 2).sum() / n))
        for more in DEVIATIONS:
            over = lambda x: x[:, column] - chance * x[:, 0] - more * deviation * np.sqrt(x[:, 0])  # noqa: B023, E731
            x, ys = over(bad), [over(g) for g in lengths]
            for cut in CUTS:
                hit, false = (x > cut).sum(), len(good) * max([0.0, *((y > cut).mean() for y in ys)])
                f = 2 * hit / max(1, hit + false + len(x))
                if (f, more) > best:
                    best, model = (f, more), Model(extra, ordinary, least, cut, chance, more * deviation)
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(model.toxic, model.ordinary)
        for part, data, at in pieces(batches):
            values, first = gains(data, at)
            total = np.concatenate([[0], np.cumsum(np.maximum(values - model.window_gain, 0))])
            windows = np.diff(first)
            evidence = np.maximum(total[first[1:]] - total[first[:-1]] - model.chance * windows, 0.0)
            score = evidence / (evidence + model.text_gain + model.spread * np.sqrt(windows)) if np.isfinite(model.text_gain) else evidence * 0.0
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(score)], [*names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, score, predicted) for each row of docs (doc_id, text), from the whole text.

    score is 0.5 where the evidence reaches the threshold for the text's length and grows with it. Null and empty
    texts score 0. Equal texts score alike; other columns aren't read; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(model), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model calls toxic, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
            scores = np.concatenate([x.column("score").to_numpy() for x in _scores(model)(iter([only]))] or [np.zeros(0)])
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
