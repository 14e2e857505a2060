"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file's pieces and log scores are read, not trained. White space becomes the marker
U+2581, one marker stands before the text, and what no piece covers falls back to byte pieces. No piece
holds a marker after another character, so the best path of a text is that of its words, each with the
markers before it; words are looked up together, all of a batch's distinct words step by step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import pieces
from .shared import bounded_batches

#: The marker in UTF-8, and the default place of the vocabulary file (a parameter of every operator here).
MARK = "\u2581".encode()
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids a task remembers, in each of two generations (some 200 bytes a word), and the longest such word.
WORDS, LONGEST_WORD = 40_000, 64


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return out, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        elif kind == 2:
            n, i = number(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


class Vocabulary:
    """Pieces with their scores, laid out as a double-array trie over bytes.

    base[s] + c is the child of state s by byte c if check there is s; piece[s] is the id that ends at s."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[bytes] = []
        scores, kinds = [], []
        for number, value in _fields(raw):
            if number == 1:
                field = dict(_fields(value))
                self.pieces.append(field.get(1, b""))
                scores.append(float(np.frombuffer(field[2], np.float32)[0]) if 2 in field else 0.0)
                kinds.append(field.get(3, 1))
        self.score = np.array(scores)
        self.unknown = kinds.index(2)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        normal = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (1, 4) and p]
        if any(p.lstrip(MARK).find(MARK) > 0 for p, _ in normal):
            raise ValueError("a piece holds a marker after another character")
        #: A character that no piece covers costs this much, below every piece, and becomes its bytes.
        self.fallback = min(self.score[i] for _, i in normal) - 10.0
        self.longest = max(len(p) for p, _ in normal)
        self._lay(normal)

    def _lay(self, normal: list[tuple[bytes, int]]) -> None:
        root: dict = {}
        for p, i in normal:
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[-1] = i
        states = 1 + sum(1 for _ in self._nodes(root))
        size = 2 * states + (1 << 16)
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        todo, hint, reached = [(root, 0)], 1, 1
        while todo:
            node, s = todo.pop()
            piece[s] = node.get(-1, -1)
            keys = np.array(sorted(c for c in node if c >= 0), np.int64)
            if not len(keys):
                base[s] = -1_000_000
                continue
            while not free[hint]:
                hint += 1
            # few children fit into gaps; many are looked for from where the array is still empty
            at = max(1, hint - int(keys[0])) if len(keys) == 1 else max(1, reached - 4096 if len(keys) < 6 else reached - 256)
            while True:
                fits = np.ones(1024, bool)
                for c in keys:
                    fits &= free[at + c : at + c + 1024]
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 1024
            base[s] = at
            free[at + keys] = False
            check[at + keys] = s
            reached = max(reached, int(at + keys[-1]))
            todo += [(node[int(c)], int(at + c)) for c in keys]
        # a look-up may reach a byte beyond the last state
        base, check, piece = base[: reached + 257], check[: reached + 257], piece[: reached + 257]
        self.base, self.check, self.piece = base, check, piece

    def _nodes(self, node: dict) -> Iterator[dict]:
        todo = [node]
        while todo:
            here = todo.pop()
            todo += [x for c, x in here.items() if c >= 0]
            yield here

    def best(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word's best path; of equal paths the one whose last piece is the longer, again and again."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lens, kind="stable")
        i = 0
        while i < len(order):
            most = max(int(lens[order[i]]), 8)
            j = int(np.searchsorted(lens[order], min(most * 2, most + 64), "right"))
            j = max(i + 1, min(j, i + max(1, (1 << 18) // most)))
            self._path([words[k] for k in order[i:j]], out, order[i:j])
            i = j
        return out

    def _path(self, words: list[bytes], out: list[np.ndarray], where: np.ndarray) -> None:
        width = max(len(w) for w in words)
        data = np.zeros((len(words), width), np.uint8)
        lens = np.array([len(w) for w in words])
        data[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(words), width + 1), np.int32)
        used = np.full((len(words), width + 1), -1, np.int32)
        lead = (data & 0xC0) != 0x80
        size = np.where(data < 0xC0, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for i in range(width):
            row = np.flatnonzero((lens > i) & lead[:, i])
            if not len(row):
                continue
            score = best[row, i]
            # the fallback for one character; any piece path is better
            end = np.minimum(i + size[row, i], lens[row])
            cost = score + self.fallback
            better = cost > best[row, end]
            r, e = row[better], end[better]
            best[r, e], back[r, e], used[r, e] = cost[better], i, -1
            state = np.zeros(len(row), np.int64)
            for j in range(i, min(width, i + self.longest)):
                live = lens[row] > j
                if not live.all():
                    row, state, score = row[live], state[live], score[live]
                to = self.base[state] + data[row, j]
                fit = to >= 0
                fit[fit] = self.check[to[fit]] == state[fit]
                row, state, score = row[fit], to[fit], score[fit]
                if not len(row):
                    break
                ids = self.piece[state]
                ends = np.flatnonzero(ids >= 0)
                if len(ends):
                    r, p = row[ends], ids[ends]
                    cost = score[ends] + self.score[p]
                    better = cost > best[r, j + 1]
                    r = r[better]
                    best[r, j + 1], back[r, j + 1], used[r, j + 1] = cost[better], i, p[better]
        at, rows = lens.copy(), np.arange(len(words))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            steps.append((rows, back[rows, at], at, used[rows, at]))
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        found: list[list] = [[] for _ in words]
        for rows, a, b, p in reversed(steps):
            for r, x, y, q in zip(rows.tolist(), a.tolist(), b.tolist(), p.tolist(), strict=True):
                if q >= 0:
                    found[r].append(q)
                else:
                    found[r].extend(self.byte_ids[np.frombuffer(words[r][x:y], np.uint8)].tolist())
        for k, f in zip(where.tolist(), found, strict=True):
            out[k] = np.array(f, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes put together, markers back to spaces, the first one dropped."""
        table = self._strings
        text = b"".join([table[i] for i in ids.tolist()])
        text = text.replace(MARK, b" ")
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")

    @property
    def _strings(self) -> list[bytes]:
        if not hasattr(self, "_made"):
            self._made = list(self.pieces)
            for c, i in enumerate(self.byte_ids.tolist()):
                self._made[i] = bytes([c])
            for i, s in enumerate(self._made):
                if i == self.unknown:
                    self._made[i] = " \u2047 ".encode()
        return self._made


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


class _Memo:
    """Ids of words met before, as bytes, in two generations of bounded size.

    A word of the older generation that is met again moves to the younger one, which becomes the older
    when it is full. So frequent words stay and the memory is bounded whatever the texts hold."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, words: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(w) or old.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(new, self.v.best([words[i] for i in new]), strict=True):
            out[i] = x.tobytes()
        for w, x in zip(words, out, strict=True):
            if len(w) <= LONGEST_WORD:
                young[w] = x
                if len(young) >= WORDS:
                    self.old, self.young = young, {}
                    young = self.young
        return out


def _encoded(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches, with all ids and where each text's ids begin."""
    memo = _Memo(v)
    for part, _, _ in pieces(batches, 1 << 20):
        texts = pc.replace_substring(part.column("text").fill_null(""), " ", "\u2581")
        # a word: its markers, then all up to the next marker
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("\u2581", texts, ""))
        found = pc.replace_substring_regex(texts, "([^\u2581])\u2581", "\\1\x00\u2581")
        # texts with NUL bytes are cut there too; NUL is in no piece, so paths stay the same
        split = pc.split_pattern(found, "\x00")
        has_nul = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        start, end = split.offsets[0].as_py(), split.offsets[-1].as_py()
        words, first = split.values.slice(start, end - start), split.offsets.to_numpy() - start
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy()
        ids = memo([w.as_buffer().to_pybytes() for w in coded.dictionary])
        lens = np.array([len(x) // 4 for x in ids], np.int64)
        begin = np.cumsum(lens) - lens
        flat = np.frombuffer(b"".join(ids), np.int32)
        n = lens[index]
        to = np.cumsum(n) - n
        take = np.arange(int(n.sum())) - np.repeat(to, n) + np.repeat(begin[index], n)
        out, cuts = flat[take], np.concatenate([to, [int(n.sum())]])[first]
        if has_nul.any():
            parts = [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for d in np.flatnonzero(has_nul):
                parts[d] = _with_nul(v, texts[int(d)].as_py())
            out, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield part, out.astype(np.int32), cuts


def _with_nul(v: Vocabulary, marked: str) -> np.ndarray:
    """A text that holds NUL, word by word."""
    words, now = [], ""
    for c in marked:
        if c == "\u2581" and now and now[-1] != "\u2581":
            words.append(now)
            now = ""
        now += c
    return np.concatenate(v.best([w.encode() for w in [*words, now]]))


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs' columns doc_id, lang and source with the ids of ``text`` (array of int), and their number.

    Each row of docs gives one; null and empty texts have no ids; rows may repeat. Memory is bounded by
    a batch and by its distinct words. The vocabulary, a file of the driver, is laid out there and goes to
    the tasks with the function; its size is that of the file."""
    bounded_batches(docs.sparkSession)
    v = vocabulary(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, cuts in _encoded(v, batches):
            lists = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(cuts)), lists], ["doc_id", "lang", "source", "n_pieces", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "lang", "source", "text")
    return rows.mapInArrow(run, "doc_id long, lang string, source string, n_pieces long, ids array<int>")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text. Marker characters of a text come back as spaces."""
    v = vocabulary(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row for each row of docs: n_pieces, n_bytes (byte pieces), log_score, ids_sha256 (of 32-bit little-endian ids)
    and round_trip (decoding gives the text again, markers in it as spaces)."""
    bounded_batches(docs.sparkSession)
    v = vocabulary(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids[v.byte_ids != v.unknown]] = True
        for part, ids, cuts in _encoded(v, batches):
            texts = part.column("text").to_pylist()
            total = np.concatenate([[0.0], np.cumsum(np.where(is_byte[ids], 0.0, v.score[ids]))])
            bytes_ = np.concatenate([[0], np.cumsum(is_byte[ids])])
            own = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(np.diff(cuts)), pa.array(np.diff(bytes_[cuts])), pa.array(np.diff(total[cuts])),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own]),
                    pa.array([v.decode(x) == (t or "").replace("\u2581", " ") for x, t in zip(own, texts, strict=True)]),
                ],
                ["doc_id", "n_pieces", "n_bytes", "log_score", "ids_sha256", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, log_score double, ids_sha256 string, round_trip boolean")
