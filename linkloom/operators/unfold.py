"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unfold(df: DataFrame, columns: list[str], array: str, item: str, keep_empty: bool = False) -> DataFrame:
    """One row per array item: the columns, the position `pos` from 0, and the item.

    With `keep_empty`, an empty array gives one row without position and item.

    The outer form with a filter behind it is on purpose.  Before a plain
    explode Spark puts a filter for non-empty arrays, which it pushes below the
    projection that makes the array: a costly expression then runs twice.
    """
    rows = df.selectExpr(*columns, f"posexplode_outer({array}) AS (pos, {item})")
    return rows if keep_empty else rows.where("pos IS NOT NULL")
