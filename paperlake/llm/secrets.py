"""Secret scans: all rules' whole expressions in one automaton, read in one pass; ends by the same rules from there.

The rules are compiled together (see automaton): subset construction and minimisation into transition arrays. One
pass over the bytes, from the end, tells every place at which a rule's match starts. From there the forward
automaton of the same rules reads on to the longest end, all starts at once. Of each kind the leftmost
matches that don't overlap are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import compiled, longest, starts
from .bytesets import pieces
from .shared import bounded_batches

#: Kind, expression (automaton's notation), letters in either case, whether the secret is only what follows
#: the first place at which a match may end, and its least length. The first three are the base.
RULES = (
    ("assign", "(password|passwd|secret|token|api_?key)[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9+/_.=-]+", True, True, 12),
    ("access", "AKIA[A-Z0-9]+", False, False, 18),
    ("hex", "[0-9a-f]{16}[0-9a-f]*", False, False, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]+", False, False, 24),
    ("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)?", False, False, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]*-----END [A-Z ]*PRIVATE KEY-----)?", False, False, 20),
)


def _spans(places: np.ndarray, rules: np.ndarray, ends: dict[tuple[int, int], tuple[int, int]], more) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start, then kind. ends: of a start and rule; more: the same for a start that isn't there."""
    out = []
    for kind in np.unique(rules).tolist():
        own = places[rules == kind]
        done = i = 0
        while True:
            i += int(np.searchsorted(own[i:], done))
            if i >= len(own):
                break
            start = int(own[i])
            first, done = ends.get((start, kind)) or more(start, kind)
            if done - (first - 1 if RULES[kind][3] else start) >= RULES[kind][4]:
                out.append((start, done, kind))
    return sorted(out)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]]:
    """Of parts of batches, the spans of each text in code points."""
    rules = tuple((r[1], r[2]) for r in RULES)
    back, ahead = compiled(rules, backwards=True), compiled(rules, anywhere=False)
    for part, data, at in pieces(batches):
        place, bits = starts(*back, data, at)
        which = (bits[:, None] >> np.arange(len(RULES))) & 1 == 1
        row, rule = np.nonzero(which)
        begin = place[row]
        owner = np.searchsorted(at, begin, "right") - 1
        # a run of starts of one rule is one match, so only its first start is followed at once
        key = rule * (len(data) + 2) + begin
        head = ~np.isin(key - 1, key) | (begin == at[owner])
        first, last = longest(*ahead, data, begin[head], at[owner[head] + 1], rule[head])
        ends = {(b, k): (f, e) for b, k, f, e in zip(begin[head].tolist(), rule[head].tolist(), first.tolist(), last.tolist(), strict=True)}

        def more(start: int, kind: int) -> tuple[int, int]:
            stop = at[np.searchsorted(at, start, "right")]
            f, e = longest(*ahead, data, np.array([start]), np.array([stop]), np.array([kind]))
            return int(f[0]), int(e[0])

        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
        for d in np.unique(owner):
            own = owner == d
            found = _spans(begin[own], rule[own], ends, more)
            if found:
                points = np.concatenate([[0], np.cumsum((data[at[d] : at[d + 1]] & 0xC0) != 0x80)])
                spans[d] = [(int(points[a - at[d]]), int(points[b - at[d]]), k) for a, b, k in found]
        yield part, spans


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, b, k in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, spans in _found(batches):
        kinds = [[k for _, _, k in s] for s in spans]
        base = [hashlib.sha256(_listed([x for x in s if x[2] < 3]).encode()).hexdigest() for s in spans]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array([k.count(i) for k in kinds], pa.int64()) for i in range(3)), pa.array(base), pa.array([_listed(s) for s in spans])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts of the base kinds, the digest of their spans, all spans.

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have none; repeated rows
    are judged each on its own; other columns aren't read; an empty table gives no rows. Texts are read
    whole, a row at a time, so matches never cross rows."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows, schema)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, spans in _found(batches):
        texts = part.column("text").to_pylist()
        for d, found in enumerate(spans):
            done, pieces_ = 0, []
            for a, b, k in found:
                if b > done:
                    pieces_ += [texts[d][done : max(a, done)], f"[{RULES[k][0]}]" if a >= done else ""]
                    done = b
            if found:
                texts[d] = "".join(pieces_) + texts[d][done:]
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with all its columns, each secret in ``text`` replaced by its kind in brackets.

    Null texts stay null and empty ones empty; repeated rows are judged each on its own; an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_redacted, docs.schema)
