"""One-row summaries.  All are counts, added up map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ok_failed(rows: DataFrame, ok: Column) -> DataFrame:
    return rows.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def link_totals(results: DataFrame) -> DataFrame:
    return _ok_failed(results, F.col("ok"))


def fact_totals(records: DataFrame) -> DataFrame:
    return _ok_failed(records, F.col("success"))


def record_totals(records: DataFrame) -> DataFrame:
    """Ok pages or papers out of all."""
    return records.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("total"))


def scan_totals(merged: DataFrame) -> DataFrame:
    """Total, new URLs, and citations gained by URLs that were there before."""
    return merged.agg(
        F.count("*").alias("total_urls"),
        F.count_if("is_new").alias("new_urls"),
        F.coalesce(F.sum("appended"), F.lit(0)).alias("updated_urls"),
    )


def verify_totals(applied: DataFrame) -> DataFrame:
    """Status counts over the checked references; no row if none was checked."""

    def checked(name: str) -> Column:
        return F.count_if(F.col("checked") & (F.col("status") == name)).alias(name)

    totals = applied.agg(
        F.count("*").alias("total"),
        F.count_if("checked").alias("verified"),
        *[checked(name) for name in ("ok", "dead", "redirect", "paywall", "login")],
        F.count_if(~F.col("checked")).alias("skipped"),
    )
    return totals.where("verified > 0")
