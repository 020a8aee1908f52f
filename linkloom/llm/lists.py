"""Wide rows and lists of ids, without a shuffle of all wide rows.

A filter of fixed size, sent to every task, tells which rows cannot be in the
list.  Only the others are shuffled to meet it.  For a list too long for the
filter, all rows are shuffled, and results stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkloom.llm.urlfilter import bloom, may_be_listed
from linkloom.operators.staging import staged


def _probed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return may_be_listed(rows, key, bloom(ids, key))


def within(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in the list."""
    ids = staged(ids.select(key).distinct())
    return _probed(rows, ids, key).where("__maybe").drop("__maybe").join(ids, key, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is null or not in the list."""
    ids = staged(ids.select(key).distinct())
    probed = _probed(rows, ids, key)
    some = probed.where("__maybe").join(ids, key, "left_anti")
    return probed.where("NOT __maybe").unionByName(some).select(*rows.columns)


def with_values(rows: DataFrame, values: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left join with a table that has one row per key."""
    values = staged(values)
    probed = _probed(rows, values, key)
    more = [c for c in values.columns if c != key]
    some = probed.where("__maybe").join(values, key, "left").select(*rows.columns, *more)
    rest = probed.where("NOT __maybe").select(*rows.columns)
    return some.unionByName(rest, allowMissingColumns=True)
