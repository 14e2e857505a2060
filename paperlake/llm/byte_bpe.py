"""Byte-level BPE encoding and decoding by an automaton of all tokens and backtracking.

A piece's bytes are mapped to Latin-1 for pyahocorasick, which gives the longest token at every place in one
pass. From there tokens are laid from the left; two neighbours may stand side by side only if merging their
bytes by rank would leave just that border, which is decided by undoing merges at the border and is remembered for each
pair. Where no token fits, the last one is taken back and a shorter one tried; a place that failed is never
tried again, so the work is linear. The result is that of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import pieces
from .shared import bounded_batches

#: The default rank file and the pattern that splits texts before merging (parameters of every operator here).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same matches as PATTERN's in less time: letters, the most frequent case, are tried first (nothing else but one space begins like them), and runs aren't given back.
LETTERS_FIRST = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Pieces that a task remembers in each of two generations, the longest such piece, and remembered pairs of tokens.
PIECES, LONGEST_PIECE, PAIRS = 150_000, 64, 1 << 18


class Ranks:
    """Tokens by rank, with what backtracking needs: each token's last merge and its longest proper prefix that is a token."""

    def __init__(self, raw: bytes) -> None:
        self.rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in raw.splitlines() if line.strip())}
        size = max(self.rank.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * size
        self.shorter, self.halves = [-1] * size, [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self.known: dict[int, bool] = {}
        self.size = [0] * size
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            self.token[r], self.size[r] = token, len(token)
            self.automaton.add_word(token.decode("latin-1"), (r, len(token) - 1))
        for token, r in self.rank.items():
            self.shorter[r] = next((self.rank[token[:i]] for i in range(len(token) - 1, 0, -1) if token[:i] in self.rank), -1)
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            left = self.shorter[r]
            while left >= 0:
                right = self.rank.get(token[len(self.token[left]) :], size)
                # the halves whose border no earlier merge removes are those that merging by rank ends with
                if left < r and right < r and self._fits(left, right):
                    self.halves[r] = (left, right)
                    self.merged[left, right] = r
                    break
                left = self.shorter[left]
        self.automaton.make_automaton()
        self.little = [r.to_bytes(4, "little") for r in range(size)]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank ends with just these two.

        The merges on both sides are undone from the latest on; at each stage the tokens at the border must not have a
        merge that would come before the one undone last (of equal ranks the one further left comes first)."""
        merged, halves = self.merged, self.halves
        before = len(self.token)
        while True:
            over = merged.get((a, b))
            if over is not None and over < before:
                return False
            left, right = halves[a], halves[b]
            if left is not None and (a > b or right is None):
                before, a = a, left[1]
            elif right is not None:
                before, b = b + 1, right[0]
            else:
                return True

    def piece(self, piece: bytes) -> list[int]:
        """The ranks of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, known, shorter = len(piece), self.size, self.known, self.shorter
        longest = [-1] * n
        for end, (r, before) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = r
        failed = bytearray(n + 1)
        out: list[int] = []
        at, last, now, pairs = 0, -1, longest[0], len(self.token)
        while True:
            while now >= 0:
                if not failed[at + size[now]]:
                    if last < 0:
                        break
                    pair = last * pairs + now
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= PAIRS:
                            known.clear()
                        fits = known[pair] = self._fits(last, now)
                    if fits:
                        break
                now = shorter[now]
            if now < 0:
                failed[at] = 1
                if last < 0:
                    raise ValueError("the rank file has no token for some byte")
                now = out.pop()
                at -= size[now]
                last = out[-1] if out else -1
                continue
            out.append(now)
            at += size[now]
            if at == n:
                return out
            last, now = now, longest[at]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(2)
def ranks(raw: bytes) -> Ranks:
    """One for each process that uses it."""
    return Ranks(raw)


class _Memo(dict):
    """Ranks of pieces met before, as little-endian bytes, in two generations of bounded size."""

    def __init__(self, r: Ranks) -> None:
        self.r, self.old = r, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = b"".join(map(self.r.little.__getitem__, self.r.piece(piece.encode())))
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def later_symbols(pattern: str) -> str:
    """Code points that this Python's classes call letters or numbers and the reference tokenizer's classes don't, as one string.

    Both libraries follow some edition of Unicode. They are asked once, on the driver, for all code points."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        if kind in pattern:
            kept = tiktoken.Encoding("classes", pat_str=f"{kind}+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
            known = set(bytes(kept).decode())
            out += [c for c in regex.findall(kind, every) if c not in known]
    return "".join(sorted(out))


class Splitter:
    """Texts to pieces. Symbols that are newer than the reference's classes count as what they are there: neither letter nor number."""

    def __init__(self, pattern: str, newer: str) -> None:
        self.pattern = regex.compile(LETTERS_FIRST if pattern == PATTERN else pattern)
        self.newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs(newer)) + "]") if newer else None
        self.beyond = re.compile(f"[{min(newer)}-\U0010ffff]") if newer else None  # one range is searched much faster than many

    def __call__(self, text: str) -> list[str]:
        if self.newer is None or text.isascii() or not self.beyond.search(text) or not self.newer.search(text):
            return self.pattern.findall(text)
        # the same places in a text in which each of them is a plain symbol
        return [text[slice(*m.span())] for m in self.pattern.finditer(self.newer.sub("☃", text))]


def _runs(symbols: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in map(ord, symbols):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _encoded(r: Ranks, split: Splitter, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    memo = _Memo(r)
    find = memo.__getitem__
    for part, _, _ in pieces(batches, 1 << 20):
        yield part, [b"".join(map(find, split(t))) if t else b"" for t in part.column("text").to_pylist()]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs' doc_id with the ids of ``text`` (array of int) and their number, without special tokens.

    Each row of docs gives one; null and empty texts have no ids; rows may repeat; other columns are left out; an empty table stays empty. The rank
    file is read by the driver and goes to the tasks with the function, where each process lays it out once. Memory is bounded by a batch, by one
    text and by what is remembered of pieces."""
    bounded_batches(docs.sparkSession)
    raw, newer = read_ranks(path), later_symbols(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(ranks(raw), Splitter(pattern, newer), batches):
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text; bytes that are no UTF-8 (a cut character) become U+FFFD."""
    raw = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(raw)
        for batch in batches:
            texts = [r.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and decoded_sha256 (of the bytes they decode to); rows as in ``encode``."""
    bounded_batches(docs.sparkSession)
    raw, newer = read_ranks(path), later_symbols(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(raw)
        for part, ids in _encoded(r, Splitter(pattern, newer), batches):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(r.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
