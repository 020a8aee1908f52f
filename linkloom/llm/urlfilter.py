"""URL filters: allow and block rules by host and path, and a block list of URLs.

A list of URLs is tested in two steps.  A blocked Bloom filter, whose size is
a parameter and does not grow with the list, is sent to every task and passes
the URLs that may be listed.  Only these are joined with the list, which
removes the false positives.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and is in no list; null entries of the list are ignored and
repeated ones count once; repeated rows are judged one by one; empty tables
give empty results.  A very long URL is read by expressions that look at each
character once.  Among fitting rules the longest wins, and of equally
long ones the one that is given first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.sql import array_of, cases, quote

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that a URL sets: one in each of the words of its block.
WORDS_PER_BLOCK = 4
BLOCKS = 1 << 15  # of 32 bytes: the filter takes a megabyte

#: Host labels that only name a variant of the same site, and query parameters that only name a visit.
SITE_VARIANTS = ("www", "m", "blog")
VISIT_PARAMETERS = ("utm_[a-z]*", "ref", "page")


@dataclass(frozen=True)
class Rule:
    """`allow` or `block` for a host with all its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> str:
        dotted = f"endswith(concat('.', {host}), {quote('.' + self.host)})"
        return f"({dotted} AND startswith({path}, {quote(self.path)}))"


def host_of(url: str) -> str:
    """SQL: between the first `://` and the path, in lower case; empty without one."""
    rest = f"substring({url}, locate('://', {url}) + 3)"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    return f"CASE WHEN locate('://', {url}) > 0 THEN translate({host}, {quote(UPPER)}, {quote(LOWER)}) ELSE '' END"


def path_of(url: str) -> str:
    """SQL: from behind the host up to a query or fragment; empty without one."""
    rest = f"substring({url}, locate('://', {url}) + 3)"
    return f"CASE WHEN locate('://', {url}) > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def canonical(url: str) -> str:
    """SQL: one text for all spellings of an address, null without host.

    Scheme, site variants, fragment, parameters of the visit, a file suffix
    and a final slash are left out.
    """
    host = f"regexp_replace({host_of(url)}, '^(?:{'|'.join(SITE_VARIANTS)})[.]', '')"
    path = f"regexp_replace({path_of(url)}, '([.]html?)?/?$', '')"
    query = f"regexp_extract(regexp_replace({url}, '#.*$', ''), '[?](.*)$', 1)"
    kept = f"filter(split({query}, '&'), p -> p <> '' AND NOT p rlike '^(?:{'|'.join(VISIT_PARAMETERS)})=')"
    return f"CASE WHEN {host_of(url)} <> '' THEN concat_ws('?', concat({host}, {path}), nullif(concat_ws('&', {kept}), '')) END"


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64({key}), {blocks})")


def _bit(key: str, word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * word}), 64) AS int))")


def bloom(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter of a list: a row for each block in use, at most `blocks` in all."""
    words = [F.bit_or(_bit(key, w)).alias(f"__w{w}") for w in range(WORDS_PER_BLOCK)]
    return listed.where(F.col(key).isNotNull()).groupBy(_block(key, blocks).alias("__block")).agg(*words)


def may_be_listed(rows: DataFrame, key: str, filter_rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Add `__maybe`: false only for keys that the list certainly lacks.

    The filter has `blocks` rows at most, whatever the list; so it can be broadcast.
    """
    joined = rows.withColumn("__block", _block(key, blocks)).join(F.broadcast(filter_rows), "__block", "left")
    bits = [F.coalesce(F.col(f"__w{w}").bitwiseAND(_bit(key, w)) != 0, F.lit(False)) for w in range(WORDS_PER_BLOCK)]
    test = bits[0]
    for more in bits[1:]:
        test = test & more
    return joined.withColumn("__maybe", test & F.col(key).isNotNull()).drop("__block", *(f"__w{w}" for w in range(WORDS_PER_BLOCK)))


def listed_flag(rows: DataFrame, key: str, listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Add `is_listed`: whether the list has the key, exactly.

    Rows that the filter rules out pass by.  Possible hits meet the distinct
    entries in a hash join, whose crowded partitions Spark can split, as one
    side has a key once.
    """
    entries = listed.where(F.col(key).isNotNull()).select(key).distinct()
    probed = may_be_listed(rows, key, bloom(entries, key, blocks), blocks)
    hits = probed.where("__maybe").join(entries.withColumn("__entry", F.lit(True)).hint("shuffle_hash"), key, "left")
    return (
        hits.withColumn("is_listed", F.col("__entry").isNotNull()).drop("__entry")
        .unionByName(probed.where("NOT __maybe").withColumn("is_listed", F.lit(False)))
        .drop("__maybe")
    )


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """Add `host`, `path`, `rule`, `is_listed` and `verdict` to every row.

    `listed` has canonical URLs in a column `canonical`.  A rule that fits
    decides; otherwise listed URLs are blocked and all others allowed.
    """
    longest_first = sorted(rules, key=lambda r: -len(r.name))
    made = ["host", "path", "rule", "is_listed", "verdict", "canonical"]
    rows = pages.select(
        *(F.col(f"`{c}`") for c in pages.columns if c.lower() not in made),
        F.expr(f"coalesce({host_of(url)}, '')").alias("host"),
        F.expr(f"coalesce({path_of(url)}, '')").alias("path"),
        F.expr(canonical(url)).alias("canonical"),
    )
    rows = listed_flag(rows, "canonical", listed, blocks)
    rule = cases([(r.fits("host", "path"), quote(r.name)) for r in longest_first], "cast(NULL AS string)")
    verdict = cases([(f"rule = {quote(r.name)}", quote(r.verdict)) for r in longest_first], "if(is_listed, 'block', 'allow')")
    return rows.withColumn("rule", F.expr(rule)).withColumn("verdict", F.expr(verdict))


def urls_of_hosts(pages: DataFrame, names: tuple[str, ...], url: str = "url") -> DataFrame:
    """Canonical URLs of the pages whose host has one of the names as a label: a list for `judge`."""
    labelled = f"arrays_overlap(split({host_of(url)}, '[.]'), {array_of(names)})"
    return pages.where(F.expr(labelled)).select(F.expr(canonical(url)).alias("canonical")).distinct()
