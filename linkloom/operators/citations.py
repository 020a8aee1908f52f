"""Markdown files to citations, and citations to references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import bare_urls, categories, markdown_links, mentions, urls_in
from linkloom.operators.unfold import unfold


def found_urls(files: DataFrame) -> DataFrame:
    """Distinct URLs of every file in first-seen order: (path, pos, url)."""
    return unfold(files, ["path"], urls_in("content"), "url")


def citations(files: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Every mention of a URL: (arg_no, path, pos, url, title).

    Links come first and bare URLs, which have no title, after them.
    `arg_no` is the place of the file's pattern among the scanned ones.  With
    `keep_empty`, a file without URLs gives one row without them.
    """
    arg_no = "arg_no" if "arg_no" in files.columns else "0 AS arg_no"
    found = unfold(files, [arg_no, "path"], mentions("content"), "mention", keep_empty)
    return found.select("arg_no", "path", "pos", "mention.url", "mention.title")


def unlinked_urls(files: DataFrame) -> DataFrame:
    """Bare URLs that no link of the same file has: (path, url)."""
    return unfold(files, ["path"], bare_urls("content", markdown_links("content")), "url").drop("pos")


def cited_in(found: DataFrame) -> DataFrame:
    """One row per (url, path) with the file's first real title for the URL.

    The key is URL *and* file, so a URL that a third of all files cite is
    spread over all partitions.
    """
    real_title = F.when(F.col("title") != F.col("url"), F.col("title"))
    return found.groupBy("url", "path").agg(
        F.min("arg_no").alias("arg_no"),
        F.min(F.when(real_title.isNotNull(), F.struct("arg_no", "pos", real_title.alias("title"))))["title"].alias(
            "title"
        ),
    )


def references(cited: DataFrame) -> DataFrame:
    """Pending references, one per URL: (url, title, categories, cited_by).

    Categories come from the first file, the title is the first one that is
    not the URL itself.  All of it are minima and counts, combined map-side,
    so that one popular URL sends one row per task.  The citing files stay
    rows of `cited_in`; here they are only counted.
    """
    order = F.struct("arg_no", "path")
    grouped = cited.groupBy("url").agg(
        F.min(order)["path"].alias("first_path"),
        F.min(F.when(F.col("title").isNotNull(), F.struct("arg_no", "path", "title")))["title"].alias("title"),
        F.count("*").alias("cited_by"),
    )
    return grouped.select(
        "url",
        F.coalesce("title", "url").alias("title"),
        F.expr(categories("first_path")).alias("categories"),
        "cited_by",
    )
