"""The commands of the toolkit as Spark jobs: scan, verify, check, refresh, fetch, papers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import citations, facts, health, pages, papers, registry, rollups
from linkloom.operators.staging import staged
from linkloom.sources.readers import registry_meta, registry_records
from linkloom.sources.records import write_json_lines
from linkloom.sources.registry_store import MOST_PARTS, RegistryStore, Version, bucket, no_version


def scan(store: RegistryStore, files: DataFrame, today: dt.date, fresh: bool = False) -> DataFrame:
    """Scan files into the registry and store it as a new version.

    Returns one row: file, scanned_files, total_urls, new_urls, updated_urls.
    What the files mention is staged, so that text is read and searched once,
    also when executors are lost later on.  Every file has one first mention,
    or one row without any: those rows count the files.

    Only the buckets that have a mentioned URL are read and written.
    """
    mentions = staged(citations.citations(files, keep_empty=True))
    scanned = mentions.where("coalesce(pos, 0) = 0").count()
    cited = staged(citations.cited_in(mentions.where("pos IS NOT NULL")))

    def job(held: Version | None) -> tuple[Version, DataFrame]:
        start = no_version(today, held.number if held else 0) if held is None or fresh else held
        buckets, number = store.grown(start), start.number + 1
        named = store.named(start, cited) if buckets == start.buckets else list(range(buckets))
        existing = store.part(start, named if buckets == start.buckets else None)
        marked = staged(registry.mark_known(cited, existing.cited_in))
        added = registry.new_citations(marked, number)
        crowded = [k for k in named if buckets != start.buckets or len(start.cited_in[k]) >= MOST_PARTS]
        if crowded:
            older = existing.cited_in.withColumn("bucket", bucket("url", buckets)).where(F.col("bucket").isin(crowded))
            added = added.unionByName(older.drop("bucket"))
        made, counters = store.store(
            start, registry.upsert(existing.references, marked), added, named, buckets, whole_pairs=crowded, scan=number
        )
        totals = rollups.scan_totals(counters).withColumn("total_urls", F.lit(made.total_links))
        return made, totals.select(F.lit(store.root).alias("file"), F.lit(scanned).alias("scanned_files"), "*")

    return store.change(job)


def verify_references(
    store: RegistryStore, crawl: DataFrame, at: dt.datetime, wanted: list[str] | None = None, dry_run: bool = False
) -> DataFrame:
    """Judge the selected references by a crawl; store the outcome unless `dry_run`.

    Returns one row: summary (the counts), file and timestamp, or no row if
    nothing was selected (nothing is stored then).  Only the buckets that have
    a crawled URL are read and written.
    """
    moment = F.lit(at).cast("timestamp")
    verdicts = staged(health.verify(crawl))

    def job(held: Version | None) -> tuple[Version | None, DataFrame]:
        if held is None:
            raise FileNotFoundError(f"no registry at {store.root}")
        named = [k for k in store.named(held, verdicts) if held.references[k]]
        applied, made = registry.apply_verdicts(store.part(held, named).references, verdicts, moment, wanted), None
        if not dry_run and not applied.where("checked").isEmpty():
            made, applied = store.store(held, applied, None, named, last_verified=at)
        totals = rollups.verify_totals(applied)
        totals = totals.withColumn("total", F.lit(held.total_links)).withColumn("skipped", F.col("total") - F.col("verified"))
        report = totals.select(F.struct(*totals.columns).alias("summary"), F.lit(store.root).alias("file"), moment.alias("timestamp"))
        return made, report

    return store.change(job)


def import_records(store: RegistryStore, records: str, meta: str | None = None, today: dt.date | None = None) -> Version:
    """Put a registry kept as JSON lines in force: its records, and the one `meta` object beside them.

    Without `meta` the registry is created `today`.
    """
    spark = store.spark
    created, last_verified = (today or dt.date.today(), None) if meta is None else registry_meta(spark, meta)
    rows = registry_records(spark, records)
    return store.change(store.replace_with(rows, created, last_verified))


def export_records(store: RegistryStore, records: str, meta: str, version: int | None = None) -> None:
    """Write a version as JSON lines, in the order of URLs, and its `meta` object beside them."""
    nested = registry.records(store.read(version))
    write_json_lines(nested.orderBy("url", F.col("part").asc_nulls_first()), records)
    write_json_lines(store.meta(version).drop("version"), meta)


def check(urls: DataFrame, crawl: DataFrame, retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """Link results, one per list entry, and their totals."""
    results = health.check_links(urls, crawl, retries)
    return results, rollups.link_totals(results)


def refresh(urls: DataFrame, crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts, one record per list entry, and their totals."""
    records = facts.refresh(urls, crawl)
    return records, rollups.fact_totals(records)


def fetch(
    crawl: DataFrame, urls: DataFrame | None = None, raw: bool = False, order: str = "tag"
) -> tuple[DataFrame, DataFrame]:
    """Structured pages and their totals."""
    records = pages.fetch(crawl, urls, raw, order)
    return records, rollups.record_totals(records)


def read_papers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structured papers and their totals."""
    records = papers.extract(docs)
    return records, rollups.record_totals(records)
