"""Written intermediate tables, for results that several steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session, whose one machine is the whole cluster, may go
    without: it gets one temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="linkloom-")
    return _local_dirs[context.applicationId]


def staged(df: DataFrame) -> DataFrame:
    """Write a table once and read it back.

    Costly steps before it then run once, and lost executors do not bring
    them back; readers still get column pruning and statistics.
    """
    spark = df.sparkSession
    place = f"{staging_dir(spark)}/linkloom-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(place)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def staged_by(spark: SparkSession, since: int = 0) -> list[str]:
    """Folders of the tables that this application has staged, but for the first `since`."""
    return _written.get(spark.sparkContext.applicationId, [])[since:]


@contextmanager
def cleaning_up(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that were staged inside.

        with cleaning_up(spark):
            commands.fetch(crawl, urls)[0].write.parquet(place)
    """
    before = len(staged_by(spark))
    try:
        yield
    finally:
        release(spark, staged_by(spark, before))


def release(spark: SparkSession, places: list[str]) -> None:
    """Remove staged tables.

    For a caller that has written or collected what was made from them; frames
    that still read them fail afterwards.
    """
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
