"""Facts quoted on pages: dollar amounts, percentages, followers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import fixed_values as fixed
from linkloom.functions import facts
from linkloom.functions.sql import quote
from linkloom.functions.urls import fact_type, fact_urls, user_name
from linkloom.operators.snapshot import ORDER, UrlList, first_attempts, in_order
from linkloom.operators.unfold import unfold


def listed_urls(files: DataFrame) -> DataFrame:
    """URLs with facts in every file: (path, pos, url, type)."""
    found = unfold(files, ["path"], fact_urls("content"), "found")
    return found.select("path", "pos", "found.url", "found.type")


def typed(urls: DataFrame) -> DataFrame:
    """(url, type) by routing, for URLs that come without a type."""
    return urls if "type" in urls.columns else urls.withColumn("type", F.expr(fact_type("url")))


def _everything(pages: DataFrame) -> DataFrame:
    """All facts of every page, whatever its type."""
    error = "error" if "error" in pages.columns else "cast(NULL AS string)"
    kept = [ORDER] if ORDER in pages.columns else []
    return pages.selectExpr(
        "url",
        *kept,
        "html IS NOT NULL AS success",
        f"{facts.quick_title('html')} AS title",
        f"{facts.amounts('html')} AS amounts",
        f"{facts.percentages('html')} AS percentages",
        f"{facts.followers('html')} AS followers",
        f"if(html IS NOT NULL, {user_name('url')}, NULL) AS username",
        f"if(html IS NULL, coalesce({error}, {quote(fixed.NO_CONTENT)}), NULL) AS error",
    )


def _by_type(found: DataFrame) -> DataFrame:
    """Profiles keep followers and user name, other pages the rest; no empty arrays."""
    kind = F.when(F.col("type").isin("instagram", "statista"), F.col("type")).otherwise("generic")
    profile = F.col("type") == "instagram"
    return found.select(
        "url",
        kind.alias("type"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.when(~profile, F.col("title")).alias("title"),
        F.when(~profile & (F.size("amounts") > 0), F.col("amounts")).alias("amounts"),
        F.when(~profile & (F.size("percentages") > 0), F.col("percentages")).alias("percentages"),
        F.when(profile, F.col("followers")).alias("followers"),
        F.when(profile, F.col("username")).alias("username"),
        F.when(F.col("success").isNull(), F.lit(fixed.NOT_CRAWLED)).otherwise(F.col("error")).alias("error"),
    )


def read_off(pages: DataFrame) -> DataFrame:
    """Facts of every page by its URL's type: (url, type, success, title, amounts, ...).

    A failed navigation that still left some HTML is a success; only a page
    without HTML is not.
    """
    return _by_type(_everything(pages).withColumn("type", F.expr(fact_type("url"))))


def refresh(urls: DataFrame, crawl: DataFrame) -> DataFrame:
    """Facts for each entry of a list of (url) or (url, type).

    Facts are read in the row that holds the page, so that the join carries a
    few short values instead of HTML; totals alone run no pattern.  `market` pages are reported as
    `generic`.
    """
    listed = UrlList(typed(urls).select("url", "type"))
    return _by_type(listed.attach(_everything(first_attempts(in_order(listed.restrict(crawl))))))
