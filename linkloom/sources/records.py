"""JSON-lines sink for records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHOWS_NULL = {"amounts", "last_verified"}  # a null inside or in place of these is printed
_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"}


def json_object(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object per row, fields in column order.

    Nulls and empty arrays are left out, except where the format prints null.
    """
    fields = []
    for name in columns or df.columns:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.ArrayType):
            value = F.when(F.size(value) > 0, value)
        keep_nulls = name in SHOWS_NULL
        text = F.to_json(F.struct(value.alias(name)), {**_FORMAT, "ignoreNullFields": str(not keep_nulls).lower()})
        if keep_nulls and name != "last_verified":
            text = F.when(value.isNotNull(), text)
        fields.append(F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("")))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(json_object(df).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)
