"""Sharding: groups that stay together, dealt to shards by longest processing time first.

Jobs are sorted by size, and each goes to the shard with the least load so
far, kept in a heap.  A group that holds a share of all bytes worth noting is
a job of its own.  Smaller groups are bundled by the hash of their key, and a
bundle is a job; so there are at most `2 * fineness * shards` jobs, at any
size of the input, while no group is ever torn.  The heap sees jobs only, as
(id, size); rows and groups stay distributed.

The law kept is `bytes`: loads differ by about one bundle at most, unless one
group alone is larger than a shard.

Defined results: a null text is an empty one, of size 16; equal texts, null
and empty ones included, are one group; jobs of equal size go by their id and
shards of equal load by their number; repeated rows take a slot each; an
empty table gives an empty result; other columns are not kept.  A very long text
is a job of its own, and a shard with little else.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.staging import staged

ROW_BYTES = 16
FINENESS = 250  # a group above the 250th part of a shard is a job of its own
ROWS_PER_CELL = 50_000


def longest_first(jobs: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each job: the largest job first, to the least loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(jobs, key=lambda job: (-job[1], job[0])):
        load, shard = heapq.heappop(loads)
        placed[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, group): all that sharding needs of a row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("group"),
    )


def _bundle(bundles: int) -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string"))


def place(rows: DataFrame, shards: int = 40, fineness: int = FINENESS) -> DataFrame:
    """Add `shard` to rows with `group` and `size`."""
    bundles = fineness * shards
    groups = staged(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * bundles > F.lit(total)  # fewer than `bundles` groups can be
    job = F.when(large, F.concat(F.lit("g"), F.hex("group"))).otherwise(_bundle(bundles))
    jobs = groups.groupBy(job.alias("job")).agg(F.sum("bytes").alias("bytes")).collect()
    shard_of = longest_first([(j.job, j.bytes) for j in jobs], shards)
    # A row per job, of which there are 2 * bundles at most.
    table = rows.sparkSession.createDataFrame(list(shard_of.items()), "job string, shard int")
    alone = table.where("job LIKE 'g%'").select(F.unhex(F.substring("job", 2, 64)).alias("group"), F.col("shard").alias("__own"))
    shared = table.where("job LIKE 'b%'").select("job", F.col("shard").alias("__shared"))
    return (
        rows.withColumn("job", _bundle(bundles))
        .join(F.broadcast(alone), "group", "left")
        .join(F.broadcast(shared), "job", "left")
        .withColumn("shard", F.coalesce("__own", "__shared"))
        .drop("__own", "__shared", "job")
    )


def number_slots(placed: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Add `slot`, from 0 without gaps in each shard.

    A shard's rows are split into cells by the hash of their id; a row's slot
    is its place in its cell behind the rows of the cells before, so no task
    ever orders a whole shard.
    """
    placed = staged(placed)
    rows, shards = placed.agg(F.count("*"), F.countDistinct("shard")).first()
    cells = max(8, -(-rows // (rows_per_cell * max(shards, 1))))
    placed = placed.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "group"), F.lit(cells)))
    counts = placed.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place_in_cell = Window.partitionBy("shard", "__cell").orderBy("doc_id", "group")
    return (
        placed.withColumn("__place", F.row_number().over(place_in_cell) - 1)
        .join(starts, ["shard", "__cell"])
        .withColumn("slot", (F.col("__start") + F.col("__place")).cast("bigint"))
        .drop("__cell", "__place", "__start")
    )


def shard(docs: DataFrame, shards: int = 40, fineness: int = FINENESS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) for every row of `docs`."""
    return number_slots(place(staged(sized(docs)), shards, fineness))
