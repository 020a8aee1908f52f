"""Crawl snapshots: picking attempts, and joining results to lists of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.staging import staged

COPIES_PER_SLICE = 100_000
URLS_PER_WORD = 4  # of 64 bits, three of them for each URL: about one in fifty others passes
MOST_WORDS = 1 << 20  # of two numbers each: the filter is never larger than some 30 megabytes
CROWDED = 16  # URLs per word from which on a filter of that size would let most rows pass


ORDER = "__order"


def in_order(crawl: DataFrame) -> DataFrame:
    """Crawl rows with `__order`: (attempt, checksum), a narrow key that tells which row of a URL counts.

    The attempt made first comes first.  Rows that repeat an attempt follow the
    checksum of what they hold, so the choice depends on contents and not on
    the order of files; rows with one checksum are alike.
    """
    attempt = F.col("attempt") if "attempt" in crawl.columns else F.lit(1)
    held = [F.col(c) for c in crawl.columns if c not in ("url", "attempt")]
    return crawl.withColumn(ORDER, F.struct(attempt.cast("int").alias("attempt"), F.xxhash64(*held).alias("checksum")))


def one_per_url(results: DataFrame, *more_keys: str) -> DataFrame:
    """Of each URL the result whose row comes first by `__order`.

    Every column is an aggregate of its own with the same narrow order, so all
    come from one row, combine map-side, and those that nobody reads are never
    computed: column pruning goes through to the page's parsing.  Results that
    come without an order have one row per URL already, or the least counts.
    """
    keys = ["url", *more_keys]
    rest = [c for c in results.columns if c not in (*keys, ORDER)]
    if ORDER not in results.columns:
        return results.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__best")).select(*keys, "__best.*")
    return results.groupBy(*keys).agg(*(F.min_by(c, ORDER).alias(c) for c in rest))


def first_attempts(crawl: DataFrame) -> DataFrame:
    """Rows of each URL's first attempt; a snapshot without attempts is taken as it is.

    Nearly all are number 1 and pass by.  Of the rest, only rows of URLs that
    have no earlier attempt stay.
    """
    if "attempt" not in crawl.columns:
        return crawl
    least = crawl.groupBy("url").agg(F.min("attempt").alias("attempt")).where("attempt > 1")
    late = crawl.where(F.col("attempt") > 1).join(least, ["url", "attempt"], "left_semi").select(*crawl.columns)
    return crawl.where(F.col("attempt") <= 1).unionByName(late).drop("attempt")


class UrlList:
    """A list of URLs, duplicates and all, to be joined with results by URL.

    A list may name one URL in a third of its rows.  So equal entries are
    counted first (map-side), joins see each once, and copies are made behind
    them.  Besides `url`, a list should have columns with few values per URL
    only, such as a type.
    """

    def __init__(self, urls: DataFrame):
        self.counted = staged(urls.groupBy(*urls.columns).agg(F.count("*").alias("__n")))

    def restrict(self, crawl: DataFrame) -> DataFrame:
        """Leave out crawl rows that the list does not name, before any work on them.

        A filter that grows with the list, up to a fixed size, is sent to every
        task, and no HTML is shuffled.  Some rows that are not listed may pass;
        `attach` drops them.  A list too long for the largest filter meets the
        crawl in a semi-join instead, before any page is parsed.
        """
        listed = self.counted.count()
        if listed > CROWDED * MOST_WORDS:
            return crawl.join(self.counted.select("url").distinct(), "url", "left_semi").select(*crawl.columns)
        words = 1 << 10
        while words * URLS_PER_WORD < listed and words < MOST_WORDS:
            words *= 2
        place = F.pmod(F.xxhash64("url"), F.lit(words))
        bits = self.counted.groupBy(place.alias("__place")).agg(F.bit_or(_mask()).alias("__bits"))
        probed = crawl.withColumn("__place", place).join(F.broadcast(bits), "__place")
        return probed.where(F.col("__bits").bitwiseAND(_mask()) == _mask()).select(*crawl.columns)

    def attach(self, results: DataFrame, copies_per_slice: int = COPIES_PER_SLICE) -> DataFrame:
        """Left join: one output row per list entry.

        An entry's copies are made slice by slice, and slices are dealt out
        first, so those of one result come from many tasks.
        """
        joined = self.counted.join(one_per_url(results), "url", "left")
        last = F.floor((F.col("__n") - 1) / copies_per_slice)
        sliced = joined.select("*", _numbered(last).alias("__slice")).repartition("url", "__slice")
        left_over = F.col("__n") - F.col("__slice") * copies_per_slice
        size = F.least(F.lit(copies_per_slice).cast("bigint"), left_over)
        return sliced.select("*", _numbered(size - 1).alias("__copy")).drop("__n", "__slice", "__copy")


def _mask() -> Column:
    """Three bits of a word, by the URL's second hash."""
    bits = [F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(url, 'bits'), {6 * k}), 64) AS int))") for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _numbered(last: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))
