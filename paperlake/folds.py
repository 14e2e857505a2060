"""Ordered folds over groups of rows: what joins and windows can't say because each row's fate depends on those kept before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: A group's key and its rows in order, as tuples, to the rows that come of it.
Step = Callable[[tuple, Iterator[tuple]], Iterable[tuple]]


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], step: Step, schema: str) -> DataFrame:
    """step(key, rows) for each group, its rows in order and one at a time; what it yields has ``schema``, the keys first.

    Groups are dealt by their keys and sorted by Spark, which spills, so a task holds only what step itself keeps. Null keys are a
    group. Rows that tie in ``order`` come in any order, so orders should be whole where that matters."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    names, n = [*keys, *columns], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        held: list[tuple] = []
        for key, group in groupby(tuples, lambda row: row[:n]):
            for out in step(key, (row[n:] for row in group)):
                held.append((*key, *out))
                if len(held) >= 10_000:
                    yield _batch(held, kinds)
                    held = []
        if held:
            yield _batch(held, kinds)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*names).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
