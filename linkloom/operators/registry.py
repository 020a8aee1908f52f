"""Registry operations: upsert, selection, verification, checks, nesting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom import fixed_values as fixed
from linkloom.functions.urls import categories
from linkloom.operators.staging import staged
from linkloom.schemas import CITED_IN, REFERENCES

PATHS_PER_ROW = 10_000


@dataclass(frozen=True)
class Registry:
    """`references`: one row per URL; `cited_in`: one row per (url, path)."""

    references: DataFrame
    cited_in: DataFrame


def empty(spark) -> Registry:
    return Registry(spark.createDataFrame([], REFERENCES), spark.createDataFrame([], CITED_IN))


# --- upsert --------------------------------------------------------------------


def mark_known(cited: DataFrame, existing: DataFrame) -> DataFrame:
    """Scanned (url, path) pairs with a flag: does the registry already hold the pair?

    Both sides are spread by (url, path), so no URL is a hot key here.
    """
    held = existing.select("url", "path", F.lit(True).alias("known"))
    return cited.join(held, ["url", "path"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def upsert(existing: DataFrame, marked: DataFrame) -> DataFrame:
    """Full outer merge of scanned URLs into references.

    A held title gives way only if it is the bare URL and the scan has a real
    one; categories, status, verified and notes stay.  New URLs come in as
    pending, and nothing is ever deleted.  `is_new` and `appended` (citing
    files that a held URL gained) are what the counters add up.
    """
    scanned = marked.groupBy("url").agg(
        F.min(F.struct("arg_no", "path"))["path"].alias("first_path"),
        F.min(F.when(F.col("title").isNotNull(), F.struct("arg_no", "path", "title")))["title"].alias("new_title"),
        F.count_if(~F.col("known")).alias("unseen"),
    )
    held = existing.select("url", "title", "categories", "status", "verified", "notes", F.lit(True).alias("held"))
    both = held.join(scanned, "url", "full")
    is_new = F.col("held").isNull()
    keeps_title = (F.col("title") != F.col("url")) | F.col("new_title").isNull()
    return both.select(
        "url",
        F.when(is_new, F.coalesce("new_title", "url"))
        .when(keeps_title, F.col("title"))
        .otherwise(F.col("new_title"))
        .alias("title"),
        F.when(is_new, F.expr(categories("first_path"))).otherwise(F.col("categories")).alias("categories"),
        F.when(is_new, F.lit("pending")).otherwise(F.col("status")).alias("status"),
        "verified",
        "notes",
        is_new.alias("is_new"),
        F.when(is_new, 0).otherwise(F.coalesce("unseen", F.lit(0))).cast("bigint").alias("appended"),
    )


def new_citations(marked: DataFrame, scan: int) -> DataFrame:
    """Pairs to append to `cited_in`.  They follow the pairs of earlier scans."""
    return marked.where(~F.col("known")).select("url", "path", "arg_no", F.lit(scan).alias("scan"))


def merge(existing: Registry, cited: DataFrame, scan: int) -> Registry:
    """Registry after a scan.  To store it, see `linkloom.plans.commands.scan`.

    The marked pairs are staged: both tables come from them, and searching
    the scanned text a second time would cost far more.
    """
    marked = staged(mark_known(cited, existing.cited_in))
    return Registry(
        upsert(existing.references, marked),
        existing.cited_in.unionByName(new_citations(marked, scan)),
    )


# --- selection and verification -------------------------------------------------


def in_categories(wanted: list[str] | None) -> Column:
    """Is the reference selected?  Without a list, all are."""
    if wanted is None:
        return F.lit(True)
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap("categories", F.array(*[F.lit(w) for w in wanted]))


def select_references(references: DataFrame, wanted: list[str] | None) -> DataFrame:
    return references.where(in_categories(wanted))


def apply_verdicts(
    references: DataFrame, verdicts: DataFrame, at: Column, wanted: list[str] | None = None
) -> DataFrame:
    """Overwrite status, verified and notes of selected references.

    `verdicts` has one row per URL.  A reference without a verdict keeps what
    it has.  `checked` tells which rows were overwritten.
    """
    found = verdicts.select("url", F.struct("status", "notes").alias("verdict"))
    checked = F.coalesce(in_categories(wanted) & F.col("verdict").isNotNull(), F.lit(False))
    return references.join(found, "url", "left").select(
        "url",
        "title",
        "categories",
        F.when(checked, F.col("verdict.status")).otherwise(F.col("status")).alias("status"),
        F.when(checked, at).otherwise(F.col("verified")).alias("verified"),
        F.when(checked, F.col("verdict.notes")).otherwise(F.col("notes")).alias("notes"),
        checked.alias("checked"),
    )


def by_url(references: DataFrame) -> DataFrame:
    """Byte order of the URL: a range-partitioned sort, not a single-task one."""
    return references.orderBy("url")


# --- contract checks --------------------------------------------------------------


def violations(registry: Registry, meta: DataFrame | None = None) -> DataFrame:
    """Rows that break the registry contract: (url, rule); url is null for `meta` rules."""
    cited = registry.cited_in.groupBy("url").agg(F.lit(True).alias("is_cited"))
    url, title = F.col("url"), F.col("title")
    rules = {
        "url_required": url.isNull(),
        "url_format": url.isNotNull() & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$"),
        "title_required": title.isNull(),
        "title_empty": title == "",
        "categories_required": F.col("categories").isNull(),
        "categories_empty": F.size("categories") == 0,
        "cited_in_empty": F.col("is_cited").isNull(),
        "status_required": F.col("status").isNull(),
        "status_unknown": ~F.col("status").isin(fixed.STATUSES),
    }
    broken = _broken(registry.references.join(cited, "url", "left"), rules, url)
    if meta is None:
        return broken
    created = F.col("created").cast("string")
    meta_rules = {
        "created_required": created.isNull(),
        "created_format": ~created.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "tool_required": F.col("tool").isNull(),
        "tool_unknown": F.col("tool") != fixed.REGISTRY_TOOL,
        "total_links_required": F.col("total_links").isNull(),
        "total_links_negative": F.col("total_links") < 0,
    }
    return broken.unionByName(_broken(meta, meta_rules, F.lit(None).cast("string")))


def _broken(rows: DataFrame, rules: dict[str, Column], url: Column) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return rows.select(url.alias("url"), F.explode(names).alias("rule"))


# --- nesting ----------------------------------------------------------------------


def nested(registry: Registry, paths_per_row: int = PATHS_PER_ROW) -> DataFrame:
    """References with `cited_in` as an array, in scan and file order.

    A row has `paths_per_row` files at most; `part` numbers the rows of a URL
    from 0, and every row but its last is full.  So a URL with few files has
    one row, and a very popular one as many as it takes, in order.  Places are
    counted share by share of a range partitioning: no task sees all files of
    a URL.
    """
    order = ["url", "scan", "arg_no", "path"]
    ordered = registry.cited_in.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = staged(ordered.withColumn("share", F.spark_partition_id()))
    counts = ordered.groupBy("url", "share").agg(F.count("*").alias("n"))  # a row per URL and share
    before = Window.partitionBy("url").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("url", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("url", "share").orderBy("scan", "arg_no", "path")
    placed = ordered.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["url", "share"])
    grouped = (
        placed.withColumn("part", F.floor((F.col("start") + F.col("place")) / paths_per_row).cast("int"))
        .groupBy("url", "part")
        .agg(F.array_sort(F.collect_list(F.struct("scan", "arg_no", "path"))).alias("files"))
        .select("url", "part", F.transform("files", lambda f: f["path"]).alias("cited_in"))
    )
    return registry.references.join(grouped, "url", "left")


def records(registry: Registry) -> DataFrame:
    """Whole registry entries in field order, as the JSON sink writes them.

    Further records of a URL, with the files beyond the first PATHS_PER_ROW,
    say so by their `part`.
    """
    fields = ["url", "title", "categories", "cited_in", "status", "verified", "notes"]
    return nested(registry).select(*fields, F.nullif("part", F.lit(0)).alias("part"))
