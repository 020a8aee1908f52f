"""Loading test tables and derived views."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from linkloom.plans.views import VIEWS

_TABLES_OF = {
    "corpus": ("documents", "pages"),
    "notes": ("conversations", "pages"),
    "papers": ("documents",),
    "crawl": ("pages",),
    "facts": ("pages",),
    "rich_pages": ("pages",),
    "bare_pages": ("pages",),
}


#: Session setting: into how many parts a view deals out its main table; without it, the table's own splits stay.
PARTS = "spark.linkloom.viewParts"


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows as the session asks for it.

    The test tables have one row group each, which Spark reads in one task,
    however many cores there are.  Tables of a real size need no dealing out.
    """
    parts = df.sparkSession.conf.get(PARTS, None)
    return df.repartition(int(parts)) if parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    main, *others = _TABLES_OF[name]  # the main one holds the text
    rows = {main: spread(table(spark, sf_dir, main)), **{t: table(spark, sf_dir, t) for t in others}}
    escaped = VIEWS[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (documents|pages|conversations)\b", r"\1 {\2}", escaped), **rows)
