"""Small tables as literals in filters, which reach Parquet's statistics, page indexes and bloom filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows that are fetched to the driver to become literals.
MOST_LITERALS = 400


def fetched(df: DataFrame, most: int = MOST_LITERALS) -> tuple[DataFrame, list | None]:
    """`df` as a local table and its rows if they are at most `most`, else `df` as it is and None."""
    rows = df.limit(most + 1).collect()
    return (df.sparkSession.createDataFrame(rows, df.schema), rows) if len(rows) <= most else (df, None)


def either(conditions: list[Column]) -> Column:
    """A balanced tree of alternatives: a chain of hundreds would be as many levels deep."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2], strict=False)] + conditions[len(conditions) // 2 * 2 :]
    return conditions[0]


def among(column: str, values) -> Column:
    """`column` is one of `values`, as alternatives of equalities: beyond ten values Spark hands an IN to Parquet as a range only."""
    return either([F.col(column) == v for v in sorted(set(values))])
