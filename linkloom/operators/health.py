"""Link health over a crawl: verdicts for the registry, results for link lists.

HTML is judged in the row it is read in.  Only the outcome, a few short
columns, ever goes through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom import fixed_values as fixed
from linkloom.functions.health import http_status, verdict
from linkloom.functions.urls import left_domain
from linkloom.operators.snapshot import UrlList, first_attempts, in_order, one_per_url


def verdicts(crawl: DataFrame) -> DataFrame:
    """Registry verdict of every crawl row, by its first attempt: (url, status, notes)."""
    rows = first_attempts(crawl)
    kept = ["__order"] if "__order" in rows.columns else []
    judged = rows.selectExpr(
        "url", f"{verdict('url', 'final_url', 'title', 'html', 'error')} AS verdict", *kept
    )
    return judged.select("url", "verdict.status", "verdict.notes", *kept)


def verify(crawl: DataFrame) -> DataFrame:
    """One verdict per URL."""
    return one_per_url(verdicts(in_order(crawl)))


def link_results(crawl: DataFrame, retries: int = 1) -> DataFrame:
    """One result per URL: (url, status, error, redirect_to, ok).

    The next attempt counts if the first came to nothing and a retry is
    allowed; more than one retry is never made.  Attempts go by their order,
    whatever their numbers.  HTML is not read.

    A repeated attempt is settled first; then a task sends at most two rows per
    URL, however many attempts there were.
    """
    status = F.expr(http_status("title", "error"))
    narrow = in_order(crawl.drop("html"))
    tried = narrow.select(
        "url",
        F.col("__order.attempt").alias("attempt"),
        F.struct(
            status.alias("status"),
            "error",
            F.when(
                status.between(200, 399) & F.expr(left_domain("url", "final_url")), F.col("final_url")
            ).alias("redirect_to"),
        ).alias("result"),
        "__order",
    )
    by_attempt = Window.partitionBy("url").orderBy("attempt")
    turns = (
        one_per_url(tried, "attempt")
        .withColumn("turn", F.row_number().over(by_attempt))
        .where(F.col("turn") <= (2 if retries > 0 else 1))
    )
    first, second = (F.max(F.when(F.col("turn") == n, F.col("result"))) for n in (1, 2))
    both = turns.groupBy("url").agg(first.alias("first"), second.alias("second"))
    second_counts = (F.col("first.status") == 0) & F.col("second").isNotNull()
    picked = both.select("url", F.when(second_counts, F.col("second")).otherwise(F.col("first")).alias("result"))
    return picked.select("url", "result.*").withColumn(
        "ok", F.col("status").between(200, 399) & F.col("redirect_to").isNull()
    )


def check_links(urls: DataFrame, crawl: DataFrame, retries: int = 1) -> DataFrame:
    """A result for each entry of a URL list; what was not crawled has failed."""
    listed = UrlList(urls)
    joined = listed.attach(link_results(listed.restrict(crawl), retries))
    missing = F.col("status").isNull()
    return joined.withColumns(
        {
            "status": F.coalesce("status", F.lit(0)),
            "error": F.when(missing, F.lit(fixed.NOT_CRAWLED)).otherwise(F.col("error")),
            "ok": F.coalesce("ok", F.lit(False)),
        }
    )
