"""Near duplicates by T-occurrence search over inverted lists of shingles.

Texts with equal sets of shingles form a class, and one stands for it.  Two
sets of n and m shingles can only be similar if they share T(n) = share * n
shingles, so of any common order of shingles the first n - T + l hold l shared
ones.  These prefixes, in the order of their hashes, are indexed.

* Short lists (at most SHORT texts) are merged through a heap, text by text;
  those who occur as often as the threshold asks, less one for each long list
  of the text, are candidates (DivideSkip).
* A text with so many long lists that the threshold falls to nothing goes to a
  second index, over the whole sets of such texts only and in the order of
  list length.  Texts with fewer than T lists of two and more are alone.  The
  others meet in the S - T + 1 shortest of their S lists: short ones are merged
  as above, and in long ones everyone first meets the text with the largest
  share of long lists, the likeliest centre of a group of near copies.
* Candidates are verified on the whole sets, looking the shorter one's
  shingles up in the longer one: first one per text, then those that are still
  in different components.  So a group of thousands of near copies costs as
  many comparisons as it has texts, unless it falls apart; and no link between
  components is lost, whatever the length of a list.

Defined results: null and wordless texts have an empty set and link to
nothing, so each is its own component; equal texts are linked; ties between
candidates go to the smallest id; repeated rows with one id are one document;
a null id gets the component of its class; an empty table gives an empty one;
other columns are not kept.  A very long text has all its shingles, in slices of
bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.graph import components
from linkloom.llm.pieces import slices
from linkloom.llm.urlfilter import bloom, may_be_listed
from linkloom.llm.words import NOT_BLANK, grams, mix, run_hashes, split_words
from linkloom.operators.staging import staged

WORDS = 4
PERCENT = 85
SHORT = 32


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    for part in slices(texts, 4 << 20):
        words = split_words(part, NOT_BLANK, fold=True)
        hashes = grams(words.hash, size)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= size:
                found = np.sort(hashes[a : b - size + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            elif b > a:
                yield run_hashes(words.hash, np.array([a]), b - a)
            else:
                yield np.zeros(0, np.uint64)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def slack(n):
    """How many shared shingles prefixes of texts of n shingles must hold."""
    return 3 + n // 25


SIGNATURE = "doc_id bigint, n bigint, h1 bigint, h2 bigint, prefix array<bigint>"


def signatures(docs: DataFrame, size: int, percent: int, whole: bool = False) -> DataFrame:
    """(doc_id, n, h1, h2, prefix): set size, digest of the set, and the shingles to index (all, if `whole`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, prefixes = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                digests.append((mix(s).sum(dtype=np.uint64), mix(~s).sum(dtype=np.uint64)))
                keep = len(s) if whole else min(len(s), len(s) - least_overlap(len(s), percent) + slack(len(s)))
                prefixes.append(s[:keep].view(np.int64) if len(s) > 1 else s[:0].view(np.int64))
            both = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists],
                names=["doc_id", "n", "h1", "h2", "prefix"],
            )

    return docs.mapInArrow(run, SIGNATURE)


def _merge(lists: DataFrame, percent: int, prefixes: bool) -> DataFrame:
    """(a, b, shared): texts that occur often enough in the short lists of a text.

    `lists` has (x, lists); a list has (y, n, l) in the order of y, with those y
    that come after x, and x's own n and l come along.  With `prefixes` the
    threshold is the slack of the shorter prefix less the long lists, else one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, shared = [], [], []
            for x, n, l, found in zip(*(c.to_pylist() for c in batch.columns)):
                merged = heapq.merge(*([(e["y"], e["n"], e["l"]) for e in one] for one in found))
                for (y, m, k), same in groupby(merged):
                    count = sum(1 for _ in same)
                    least = min(slack(n), slack(m)) - min(l, k) if prefixes else 1
                    if count >= max(1, least) and percent * max(n, m) <= 100 * min(n, m):
                        a.append(x)
                        b.append(y)
                        shared.append(count)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, shared)], names=["a", "b", "shared"])

    return lists.mapInArrow(run, "a bigint, b bigint, shared bigint")


def _short_candidates(postings: DataFrame, short: DataFrame, percent: int, prefixes: bool) -> DataFrame:
    """Candidates from the lists of the given shingles.  Every list has SHORT texts at most."""
    entry = F.struct(F.col("rep").alias("y"), "n", "l")
    lists = postings.join(short.select("tok"), "tok").groupBy("tok").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    rows = lists.select(F.explode("list").alias("e"), "list").select(
        F.col("e.y").alias("x"), F.col("e.n").alias("n"), F.col("e.l").alias("l"),
        F.filter("list", lambda o: o["y"] > F.col("e.y")).alias("later"),
    )
    return _merge(rows.where(F.size("later") > 0).groupBy("x", "n", "l").agg(F.collect_list("later").alias("lists")), percent, prefixes)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, t in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size)):
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
                good.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    first = pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("s")), "a")
    both = first.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the named documents, written once.  A filter of fixed size keeps other texts out of the shuffle."""
    ids = ids.select(F.col("rep").alias("doc_id")).distinct()
    near = may_be_listed(docs, "doc_id", bloom(ids, "doc_id")).where("__maybe").drop("__maybe")
    found = near.join(ids, "doc_id", "left_semi")
    return staged(found.groupBy("doc_id").agg(F.first("text").alias("text")).withColumnRenamed("doc_id", "rep"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


class _Dense:
    """The second index: whole sets of the texts that the first one's long lists leave open."""

    def __init__(self, reps: DataFrame, size: int, percent: int):
        sets = staged(signatures(reps.select(F.col("rep").alias("doc_id"), "text"), size, percent, whole=True))
        postings = sets.select(F.col("doc_id").alias("rep"), "n", F.explode("prefix").alias("tok"))
        lists = staged(postings.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))
        listed = postings.join(lists, "tok")
        # Per text: its lists in the order of length, as far as similar texts must meet.
        by_text = listed.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("lists"))
        least = F.ceil(F.lit(percent) * F.col("n") / 100)
        reach = F.size("lists") - least + 1
        met = by_text.where(reach > 0).select(
            "rep", "n", F.size("lists").alias("s"),
            (F.size(F.filter("lists", lambda e: e["df"] > SHORT)) / F.col("n")).alias("center"),
            F.posexplode(F.slice("lists", F.lit(1), reach.cast("int"))).alias("at", "e"),
        )
        # Lists have one order for all, so the first that two similar texts share is within both reaches.
        self.met = staged(met.select("rep", "n", "s", "at", "center", F.col("e.tok").alias("tok"), F.col("e.df").alias("df")))
        self.percent = percent

    def _near(self, x: str, y: str) -> Column:
        """Whether the structs x and y of n, s and at leave room for the overlap that texts of their sizes need."""
        need = F.ceil(F.lit(self.percent) * (F.col(f"{x}.n") + F.col(f"{y}.n")) / (100 + self.percent))
        return (F.col(f"{x}.s") - F.col(f"{x}.at") >= need) & (F.col(f"{y}.s") - F.col(f"{y}.at") >= need)

    def short(self) -> DataFrame:
        """Candidates in short lists."""
        met = self.met.where(F.col("df") <= SHORT).select("tok", "rep", "n", F.lit(0).cast("bigint").alias("l"))
        return _short_candidates(met, met.select("tok").distinct(), self.percent, prefixes=False)

    def central(self) -> DataFrame:
        """Everyone with the likeliest centre of each of its long lists."""
        long = self._long()
        center = long.groupBy("tok").agg(F.max(F.struct("center", -F.col("rep"), "y")).alias("c"))
        pairs = long.withColumnRenamed("y", "x").join(center.select("tok", (-F.col("c.col2")).alias("other"), F.col("c.y").alias("y")), "tok")
        pairs = pairs.where(F.col("rep") != F.col("other")).where(self._near("x", "y"))
        return _counted(pairs)

    def _long(self) -> DataFrame:
        return self.met.where(F.col("df") > SHORT).select("tok", "rep", "center", F.struct("n", "s", "at").alias("y"))

    def left_over(self, component: DataFrame) -> DataFrame:
        """Texts of different components that share a long list; per list the largest component need not meet itself."""
        named = self._long().join(component, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component", "center")
        mixed = named.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("tok")
        named = staged(named.join(mixed, "tok"))
        sizes = named.groupBy("tok", "c").agg(F.count("*").alias("k"))
        main = sizes.groupBy("tok").agg(F.max(F.struct("k", "c")).alias("top")).select("tok", F.col("top.c").alias("main"))
        minor = named.join(main, "tok").where("c <> main").select("tok", "rep", F.col("y").alias("x"), "c")
        other = named.select("tok", F.col("rep").alias("other"), "y", F.col("c").alias("d"))
        return _counted(minor.join(other, "tok").where("c <> d").where(self._near("x", "y")))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).agg(F.count("*").alias("shared"))


def near_duplicates(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(signatures(docs, size, percent))
    classes = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    classes = staged(classes)
    postings = classes.where("rep IS NOT NULL AND n > 1").select("rep", "n", F.explode("prefix").alias("tok"))
    lists = staged(postings.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"))
    long = lists.where(F.col("df") > SHORT).select("tok")
    found = staged(postings.join(lists, "tok"))  # what has no list of two is gone
    open_ = found.join(long, "tok").groupBy("rep", "n").agg(F.count("*").alias("l"))
    open_ = staged(open_)
    short = found.where(F.col("df") <= SHORT).join(open_.drop("n"), "rep", "left").select("tok", "rep", "n", F.coalesce("l", F.lit(0)).alias("l"))
    candidates = _short_candidates(short, lists.where(F.col("df") <= SHORT), percent, prefixes=True)

    lower = F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) / 25) + 3  # the least slack of a similar text
    deep = open_.where(F.col("l") >= lower).select("rep")
    dense = _Dense(_texts(docs, deep), size, percent)
    candidates = candidates.unionByName(dense.short()).unionByName(dense.central())
    candidates = staged(candidates.groupBy("a", "b").agg(F.max("shared").alias("shared")))

    texts = _texts(docs, _ends(candidates))
    best = candidates.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("top")).select((-F.col("top.col2")).alias("a"), "b")
    links = staged(_verified(best, texts, size, percent))
    named = staged(components(links)).withColumnRenamed("node", "rep")
    rest = candidates.join(best, ["a", "b"], "left_anti").unionByName(dense.left_over(named)).select("a", "b").distinct()
    a, b = named.toDF("a", "ca"), named.toDF("b", "cb")
    rest = rest.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = staged(rest)
    more = staged(_verified(rest, _texts(docs, _ends(rest)), size, percent))
    final = components(links.unionByName(more)).withColumnRenamed("node", "rep")

    classes = classes.select("n", "h1", "h2", "rep").join(final, "rep", "left")
    classes = classes.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
