"""Registry upkeep over arriving files: the scan and verify commands, batch by batch.

Each micro-batch makes one registry version.  A batch that is run again after
a failure finds its URLs already there: a second scan changes nothing, and a
second verification writes the same statuses.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkloom.plans import commands
from linkloom.sources.registry_store import RegistryStore


def _each_batch(rows: DataFrame, checkpoint: str, job: Callable[[DataFrame], DataFrame], once: bool) -> StreamingQuery:
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: None if batch.isEmpty() else job(batch) and None
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_scanning(
    root: str, files: DataFrame, checkpoint: str, today: Callable[[], dt.date], once: bool = False
) -> StreamingQuery:
    """Scan a stream of (path, content) rows into the registry at `root`."""
    return _each_batch(
        files, checkpoint, lambda batch: commands.scan(RegistryStore(batch.sparkSession, root), batch, today()), once
    )


def keep_verifying(
    root: str, crawl: DataFrame, checkpoint: str, now: Callable[[], dt.datetime], once: bool = False
) -> StreamingQuery:
    """Apply a stream of crawl rows to the registry at `root`."""
    return _each_batch(
        crawl,
        checkpoint,
        lambda batch: commands.verify_references(RegistryStore(batch.sparkSession, root), batch, now()),
        once,
    )
