"""Bounded samples for fitting, chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_SCALE = 1 << 40


def some_rows(rows: DataFrame, wanted: int, of: int) -> list[Row]:
    """About `wanted` rows of a table with `of` rows, twice as many at most.

    A row is in by the hash of its contents, so no task sends more than its
    share.  The last limit only matters if very many rows are alike.
    """
    share = min(_SCALE, wanted * _SCALE // max(of, 1))
    drawn = F.pmod(F.xxhash64(*rows.columns, F.lit("sample")), F.lit(_SCALE)) < F.lit(share)
    return rows.where(drawn).limit(2 * wanted).collect()
