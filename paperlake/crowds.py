"""Groups told apart by size: rows of small groups may all meet, those of crowded ones need keys by which they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Fixed value: rows of a group up to which all its pairs are looked at, 32 a row at most.
SMALL = 64


def by_crowd(rows: DataFrame, group: str, most: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups with up to ``most`` rows, rows of the others or None if there are none); rows without a group are in neither."""
    crowds = written(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(group))
    known = rows.where(F.col(group).isNotNull())
    return (known, None) if crowds.isEmpty() else (known.join(crowds, group, "left_anti"), known.join(crowds, group, "left_semi"))
