"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, with the columns of `documents`,
and its decisions take effect.  They refer to rows: one without `doc_id` and
several of one `doc_id` are judged each for itself.  Whoever runs the stages writes each result and
reads it again, as `run` does; a stage then removes what the one before it had
staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, decontaminate, jaccard, suffixes, toxicity
from linkloom.llm.lists import without
from linkloom.llm.shipping import ship
from linkloom.operators.staging import release, staged, staged_by, staging_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7
FREED_BYTES = 1 << 20
_staged: dict[str, list[str]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lean_workers(spark: SparkSession) -> None:
    """Have Python workers give freed arrays back to the system: the stages use the same ones, one after the other.

    Otherwise what a stage has freed stays with its workers and adds to what the next one takes.
    """
    for name in ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"):
        spark.sparkContext.environment.setdefault(name, str(FREED_BYTES))


def _stage(work: Callable) -> Callable:
    """A stage that first removes what the stage before it had staged: its result is written by now."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        _lean_workers(spark)
        app = spark.sparkContext.applicationId
        release(spark, _staged.pop(app, []))
        before = len(staged_by(spark))
        result = work(spark, docs, sf_dir)
        _staged[app] = staged_by(spark, before)
        return result

    return run_stage


def _by_row(work: Callable) -> Callable:
    """A stage whose `doc_id` names one row each, in the order of ids, those without last.

    If ids do not, the rows are numbered and written once, so that the numbers
    are stable; the result has its own ids again.
    """

    @wraps(work)
    def run_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        unclear = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
        if unclear.isEmpty():
            return work(spark, docs.select(COLUMNS), sf_dir)
        spread = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "__place"]  # no task gets all rows of an id
        rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__place")).orderBy(*spread).drop("__place")
        rows = rows.withColumnRenamed("doc_id", "__id").withColumn("doc_id", F.monotonically_increasing_id())
        rows = staged(rows.select(*COLUMNS, "__id"))
        return work(spark, rows, sf_dir).drop("doc_id").withColumnRenamed("__id", "doc_id").select(COLUMNS)

    return run_rows


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    It learns from all labels but the held-out ones.  Null, empty and wordless
    texts score 0 and stay; very long ones are scored whole; a document labelled
    twice is toxic if one label says so; repeated rows are judged alike; without
    labels, or in an empty table, nothing goes.
    """
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("score") < TOXIC).select(COLUMNS)


@_stage
@_by_row
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Five words and a similarity of 0.8, the usual measure.  A document without
    words is like no other and stays.
    """
    near = jaccard.near_duplicates(docs, size=5, percent=80)
    return without(docs, near.where("doc_id <> component_id").select("doc_id"))


@_stage
@_by_row
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first; `n_chars` follows the text."""
    found = suffixes.passages(docs.select("doc_id", "text"))
    kept = suffixes.without_copies(docs, found)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))


@_stage
@_by_row
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make up less than a twentieth.

    Null and empty texts have no words and stay; very long ones are searched
    whole; repeated rows are judged alike; an empty benchmark removes nothing.
    """
    found = decontaminate.judged(decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")))
    return without(docs, found.where("contaminated").select("doc_id"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, a row for each row.

    Null and empty texts have none; very long ones are encoded whole; an empty
    table gives an empty one.
    """
    coded = bpe.encode(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]
#: The stages train a model and follow links through a graph, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again.

    A stage's result is removed when the next one's is written; the last one stays.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = f"{staging_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            release(spark, [f"{folder}/{i - 1}"])
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
