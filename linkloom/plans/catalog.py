"""One query per operator, over the test tables and the views derived from them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import facts as fact
from linkloom.functions import health as judge
from linkloom.functions import urls as url_functions
from linkloom.limits import ESTABLISHED, WHOLE, Limits, using
from linkloom.operators import citations, facts, health, pages, papers, registry, rollups
from linkloom.operators.snapshot import first_attempts
from linkloom.operators.staging import staging_dir
from linkloom.operators.unfold import unfold
from linkloom.plans import commands
from linkloom.plans.tables import table, view
from linkloom.sources.readers import crawl_of_pages, url_lines, urls_in_documents
from linkloom.sources.readers import papers as read_papers
from linkloom.sources.records import json_object
from linkloom.sources.registry_store import RegistryStore

CHECKED_AT = dt.datetime(2024, 5, 6, 7, 8, 9)
WANTED = ["architecture", "api"]


def _text(items: Column) -> Column:
    """An array as one comparable string."""
    return F.array_join(items, "|")


def _moment(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


# --- scan ------------------------------------------------------------------------


def scan_urls(spark: SparkSession, sf: str) -> DataFrame:
    return citations.found_urls(view(spark, sf, "corpus")).withColumn("pos", F.col("pos").cast("bigint"))


def scan_citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = citations.citations(view(spark, sf, "corpus"))
    return rows.select("path", F.col("pos").cast("bigint").alias("pos"), "url", "title")


def scan_unlinked(spark: SparkSession, sf: str) -> DataFrame:
    return citations.unlinked_urls(view(spark, sf, "corpus"))


def _cited(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return citations.cited_in(citations.citations(view(spark, sf, name)))


def scan_registry(spark: SparkSession, sf: str) -> DataFrame:
    found = citations.references(_cited(spark, sf, "corpus"))
    return registry.by_url(
        found.select("url", "title", _text(F.col("categories")).alias("categories"), "cited_by",
                     F.lit("pending").alias("status"))
    )


def scan_cited_in(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf, "corpus").select("url", "path", "title")


def scan_two_inputs(spark: SparkSession, sf: str) -> DataFrame:
    both = view(spark, sf, "corpus").select("path", "content").unionByName(view(spark, sf, "notes"))
    return citations.citations(both).groupBy("url").agg(F.count("*").alias("mentions"), F.min("path").alias("first_path"))


def _held(spark: SparkSession, sf: str) -> registry.Registry:
    """Registry of the corpus, as a first scan into an empty one leaves it."""
    return registry.merge(registry.empty(spark), _cited(spark, sf, "corpus"), 1)


def _merged(spark: SparkSession, sf: str) -> registry.Registry:
    return registry.merge(_held(spark, sf), _cited(spark, sf, "notes"), 2)


def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = _merged(spark, sf).references
    return rows.select("url", "title", _text(F.col("categories")).alias("categories"), "status", "is_new", "appended")


def registry_cited_in(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).cited_in.select("url", "path", F.col("scan").cast("bigint").alias("scan"))


def registry_nested(spark: SparkSession, sf: str) -> DataFrame:
    rows = registry.nested(_merged(spark, sf))
    return rows.select("url", "title", F.col("part").cast("bigint").alias("part"), _text(F.col("cited_in")).alias("cited_in"))


def upsert_counters(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.scan_totals(_merged(spark, sf).references)


def registry_filter(spark: SparkSession, sf: str) -> DataFrame:
    chosen = registry.select_references(_held(spark, sf).references, WANTED)
    return chosen.select("url", _text(F.col("categories")).alias("categories"))


def registry_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The held registry with some entries spoilt, by the length of their URL."""
    held = _held(spark, sf)
    kind = F.length("url") % 7
    spoilt = held.references.select(
        F.when(kind == 1, F.replace("url", F.lit("://"), F.lit(": "))).otherwise(F.col("url")).alias("url"),
        F.when(kind == 2, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(kind == 3, F.array().cast("array<string>")).otherwise(F.col("categories")).alias("categories"),
        F.when(kind == 4, F.lit("gone")).otherwise(F.col("status")).alias("status"),
        "verified",
        "notes",
    )
    meta = table(spark, sf, "pages").agg(
        F.lit(dt.date(2024, 1, 2)).alias("created"), F.lit("other").alias("tool"), (-F.count("*")).alias("total_links")
    )
    return registry.violations(registry.Registry(spoilt, held.cited_in), meta)


# --- URLs --------------------------------------------------------------------------


def url_list(spark: SparkSession, sf: str) -> DataFrame:
    return url_lines(unfold(view(spark, sf, "corpus"), ["path"], "split(content, '\\n')", "value"))


def url_hosts(spark: SparkSession, sf: str) -> DataFrame:
    rows = first_attempts(view(spark, sf, "crawl"))
    return rows.select(
        "url",
        F.expr(url_functions.host("url")).alias("host"),
        F.expr(url_functions.host("final_url")).alias("final_host"),
        F.expr(url_functions.left_domain("url", "final_url")).alias("left_domain"),
    )


# --- health ------------------------------------------------------------------------


def health_status(spark: SparkSession, sf: str) -> DataFrame:
    return health.verify(view(spark, sf, "crawl"))


def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.verify_totals(health_status(spark, sf).withColumn("checked", F.lit(True)))


def error_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "crawl")
    return rows.select(
        "url", F.col("attempt").cast("bigint").alias("attempt"),
        F.expr(judge.http_status("title", "error")).cast("bigint").alias("status"),
        F.expr(judge.error_class("error")).alias("error_class"),
    )


def _plain_links(rows: DataFrame) -> DataFrame:
    return rows.select("url", F.col("status").cast("bigint").alias("status"), "error", "redirect_to", "ok")


def link_results(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_links(health.link_results(view(spark, sf, "crawl")))


def link_results_no_retry(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_links(health.link_results(view(spark, sf, "crawl"), retries=0))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return citations.found_urls(view(spark, sf, "corpus")).select("url")


def check_links(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_links(health.check_links(_listed(spark, sf), view(spark, sf, "crawl")))


def link_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.link_totals(check_links(spark, sf))


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit(CHECKED_AT.isoformat(sep=" ")).cast("timestamp")
    return registry.apply_verdicts(
        _held(spark, sf).references, health.verify(view(spark, sf, "crawl")), at, WANTED
    )


def apply_verification(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf).select("url", "status", _moment(F.col("verified")).alias("verified"), "notes", "checked")


def verify_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.verify_totals(_applied(spark, sf))


# --- facts -------------------------------------------------------------------------


def amounts(spark: SparkSession, sf: str) -> DataFrame:
    rows = unfold(view(spark, sf, "corpus"), ["path"], fact.amounts("content"), "amount")
    return rows.select("path", F.col("pos").cast("bigint").alias("pos"), "amount.value", "amount.unit", "amount.raw")


def percentages(spark: SparkSession, sf: str) -> DataFrame:
    rows = unfold(view(spark, sf, "corpus"), ["path"], fact.percentages("content"), "percentage")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def fact_urls(spark: SparkSession, sf: str) -> DataFrame:
    return facts.listed_urls(view(spark, sf, "corpus")).withColumn("pos", F.col("pos").cast("bigint"))


def _plain_facts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "url", "type", "success", "title",
        _text(F.transform("amounts", lambda a: a["raw"])).alias("amounts"),
        _text(F.col("percentages")).alias("percentages"), "followers", "username", "error",
    )


def fact_records(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_facts(facts.read_off(view(spark, sf, "facts")))


def _refreshed(spark: SparkSession, sf: str) -> DataFrame:
    listed = facts.listed_urls(view(spark, sf, "corpus"))
    return facts.refresh(listed.select("url", "type"), crawl_of_pages(view(spark, sf, "facts")))


def refresh_records(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_facts(_refreshed(spark, sf))


def fact_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.fact_totals(_refreshed(spark, sf))


# --- papers ------------------------------------------------------------------------


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return papers.extract(view(spark, sf, "papers"))


def doc_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf).select(
        "url", "status", "title", "author", "date", "doi", _text(F.col("alerts")).alias("alerts"), "chars"
    )


def doc_links(spark: SparkSession, sf: str) -> DataFrame:
    return unfold(_papers(spark, sf), ["url AS doc"], "links", "link").select("doc", "link.*")


def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = unfold(_papers(spark, sf), ["url"], "sections", "section")
    return rows.select(
        "url", F.col("pos").cast("bigint").alias("pos"), F.col("section.level").cast("bigint").alias("level"),
        "section.heading", "section.content",
    )


def doc_code_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = unfold(_papers(spark, sf), ["url"], "code", "code")
    return rows.select("url", F.col("pos").cast("bigint").alias("pos"), "code.lang", "code.source")


def doc_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.record_totals(_papers(spark, sf))


# --- pages -------------------------------------------------------------------------


def _rich(spark: SparkSession, sf: str, raw: bool = False, order: str = "tag") -> DataFrame:
    return pages.fetch(crawl_of_pages(view(spark, sf, "rich_pages")), raw=raw, order=order)


def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _rich(spark, sf).select("url", "title", "site", "author", "date", "doi")


def page_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.fetch(view(spark, sf, "crawl"))
    return rows.select("url", "status", _text(F.col("alerts")).alias("alerts"), F.col("sections").isNotNull().alias("has_content"))


def page_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.record_totals(pages.fetch(view(spark, sf, "crawl"), _listed(spark, sf)))


def _plain_page_links(rows: DataFrame) -> DataFrame:
    rows = unfold(rows, ["url AS page"], "links", "link")
    return rows.select("page", F.col("pos").cast("bigint").alias("pos"), "link.text", "link.url")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_page_links(_rich(spark, sf))


def page_links_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_page_links(_rich(spark, sf, raw=True))


def _plain_sections(rows: DataFrame) -> DataFrame:
    rows = unfold(rows, ["url", "chars"], "sections", "section")
    return rows.select(
        "url", F.col("pos").cast("bigint").alias("pos"), F.col("section.level").cast("bigint").alias("level"),
        "section.heading", "section.content", "chars",
    )


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_sections(_rich(spark, sf))


def page_sections_document(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_sections(_rich(spark, sf, order="document"))


def page_text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Pages robbed of their paragraphs: one section with the first lines of the text."""
    return _plain_sections(pages.fetch(crawl_of_pages(view(spark, sf, "bare_pages"))))


def page_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = unfold(_rich(spark, sf), ["url"], "code", "code")
    return rows.select("url", F.col("pos").cast("bigint").alias("pos"), "code.lang", "code.source")


def page_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rich(spark, sf)
    return rows.select("url", json_object(rows).alias("json"))


# --- sources and registry life ------------------------------------------------------


def urls_of_document(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of every document, deduplicated in it, as `check` takes them from a file."""
    return urls_in_documents(view(spark, sf, "corpus").select("content"))


def paper_source(spark: SparkSession, sf: str) -> DataFrame:
    """Paper texts written as a table and read by the paper source, with outcome and size."""
    rows = view(spark, sf, "papers").select("path", "text", F.lit(None).cast("string").alias("error"))
    place = f"{staging_dir(spark)}/papers-{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return read_papers(spark, place).select("path", F.octet_length("text").cast("bigint").alias("bytes"))


def _stored(spark: SparkSession, sf: str) -> RegistryStore:
    """A stored registry: scanned from the corpus, scanned again from the notes, verified."""
    store = RegistryStore(spark, f"{staging_dir(spark)}/registry-{uuid.uuid4().hex}")
    commands.scan(store, view(spark, sf, "corpus").select("path", "content"), dt.date(2024, 1, 2))
    commands.scan(store, view(spark, sf, "notes"), dt.date(2025, 1, 2))
    commands.verify_references(store, view(spark, sf, "crawl"), CHECKED_AT, WANTED)
    return store


def stored_registry(spark: SparkSession, sf: str) -> DataFrame:
    """References of a registry that went through two scans and a verification, read from its store."""
    rows = _stored(spark, sf).read().references
    return rows.select("url", "title", _text(F.col("categories")).alias("categories"), "status", _moment(F.col("verified")).alias("verified"), "notes")


def stored_meta(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored(spark, sf).meta()
    return rows.select(
        F.col("version").cast("bigint").alias("version"), F.col("created").cast("string").alias("created"),
        _moment(F.col("last_verified")).alias("last_verified"), "tool", "total_links",
    )


def registry_imported(spark: SparkSession, sf: str) -> DataFrame:
    """The stored registry, exported as JSON lines with its meta and imported into another store."""
    store, place = _stored(spark, sf), f"{staging_dir(spark)}/export-{uuid.uuid4().hex}"
    commands.export_records(store, f"{place}/records", f"{place}/meta")
    other = RegistryStore(spark, f"{place}/registry")
    commands.import_records(other, f"{place}/records", f"{place}/meta")
    return registry.by_url(registry.nested(other.read()).select("url", "title", "status", _text(F.col("cited_in")).alias("cited_in")))


# --- reports -----------------------------------------------------------------------


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    totals = upsert_counters(spark, sf)
    return totals.select(json_object(totals).alias("json"))


def verify_report(spark: SparkSession, sf: str) -> DataFrame:
    totals = verify_rollup(spark, sf)
    return totals.select(json_object(totals).alias("json"))


def link_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.link_results(view(spark, sf, "crawl")).drop("ok")
    return rows.select("url", json_object(rows).alias("json"))


def fact_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.read_off(view(spark, sf, "facts"))
    return rows.select("url", json_object(rows).alias("json"))


_ALL = [
    scan_urls, scan_citations, scan_unlinked, scan_registry, scan_cited_in, scan_two_inputs,
    registry_upsert, registry_cited_in, registry_nested, upsert_counters, registry_filter, registry_violations,
    url_list, url_hosts,
    health_status, health_rollup, error_class, link_results, link_results_no_retry, check_links, link_rollup,
    apply_verification, verify_rollup,
    amounts, percentages, fact_urls, fact_records, refresh_records, fact_rollup,
    doc_fields, doc_links, doc_sections, doc_code_islands, doc_rollup,
    page_meta, page_status, page_rollup, page_links, page_links_raw, page_sections, page_sections_document,
    page_text_fallback, page_code, page_json,
    urls_of_document, paper_source, stored_registry, stored_meta, registry_imported,
    scan_report, verify_report, link_report_rows, fact_report_rows,
]
# Those that report a part under the established limits; the test views go beyond every one of these.
_CUT = [
    amounts, percentages, fact_records, refresh_records, fact_report_rows,
    doc_fields, doc_links, doc_sections, doc_code_islands,
    page_links, page_links_raw, page_sections, page_sections_document, page_text_fallback, page_code, page_json,
]
_WHOLE = [amounts, percentages, fact_records, doc_links, page_links]


def _under(chosen: Limits, query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with using(chosen):
            return query(spark, sf)

    return run


# Results are whole under the plain names, and cut under those that say so.
QUERIES = (
    {query.__name__: _under(WHOLE, query) for query in _ALL}
    | {f"{query.__name__}_limited": _under(ESTABLISHED, query) for query in _CUT}
    | {f"{query.__name__}_whole": _under(WHOLE, query) for query in _WHOLE}
)
