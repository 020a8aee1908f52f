"""Sources: markdown files, URL lists, crawls, paper texts."""

from __future__ import annotations

import datetime as dt
import json
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom import fixed_values as fixed
from linkloom.functions.urls import urls_in
from linkloom.operators.registry import PATHS_PER_ROW, Registry
from linkloom.operators.unfold import unfold
from linkloom.schemas import CRAWL, MARKDOWN, REFERENCES, TEXTDOCS
from linkloom.sources.listing import contents, listed, search


class NoFilesError(ValueError):
    """None of the patterns names a file.  The text is the error record."""


def markdown_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Files as (path, content, arg_no), one row per file and pattern that names it.

    A pattern with `*` takes any file it matches, a directory its own
    `.md` and `.markdown` files, a plain file itself, whatever their names begin
    with.  Paths that do not exist are passed over; if nothing is left,
    `NoFilesError` says so.  Files are listed and read in tasks, or by Spark's
    readers in stores that only those can open.
    """
    parts = []
    for number, pattern in enumerate(patterns):
        wanted = search(spark, pattern)
        if wanted is None:
            part = _one_pattern(spark, pattern)
        else:
            found = listed(spark, wanted)
            part = None if found is None else contents(found, wanted)
        if part is not None:
            parts.append(part.select("path", "content", F.lit(number).alias("arg_no")))
    if not parts:
        raise NoFilesError(json.dumps({"error": "no_files", "message": "No files found matching patterns"}))
    return reduce(DataFrame.unionByName, parts)


class HiddenFilesError(ValueError):
    """A pattern names files that Spark's readers pass over, as their names or folders begin with `_` or `.`."""


def _refuse_hidden(files, place, spark: SparkSession) -> None:
    """Rather no result than one without files that were asked for."""
    pattern = place.toString()
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern))
    names = [s.getPath().getName() for s in found or [] if s.isFile()]
    hidden = sorted(n for n in names if n.startswith(("_", ".")))
    if hidden:
        raise HiddenFilesError(f"cannot read, rename them: {', '.join(hidden)}")


def _refuse_hidden_below(files, pattern: str, spark: SparkSession) -> None:
    """The same for `**`, which also loses what lies in folders with such names."""
    wanted = re.compile(_glob_regex(pattern.removeprefix("./")))
    store = re.match(r"[a-z0-9]+://[^/]*", pattern)
    here = "" if store or pattern.startswith("/") else files.getWorkingDirectory().toUri().getPath().rstrip("/") + "/"
    hidden = []
    for top in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern.split("**")[0] or ".")) or []:
        root = top.getPath().toUri().getPath().rstrip("/") + "/"
        found = files.listFiles(top.getPath(), True)
        while found.hasNext():
            path = found.next().getPath().toUri().getPath()
            names = path.removeprefix(root).split("/")
            if any(n.startswith(".") or n.startswith("_") and "=" not in n for n in names):
                shown = (store.group() if store else "") + path.removeprefix(here)
                if wanted.fullmatch(shown):
                    hidden.append(shown)
    if hidden:
        raise HiddenFilesError(f"cannot read, rename them or their folders: {', '.join(sorted(hidden))}")


def _one_pattern(spark: SparkSession, pattern: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern.split("**")[0] or ".")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.read
    if "**" not in pattern:
        inside = "*" not in pattern and files.exists(place) and files.getFileStatus(place).isDirectory()
        for ending in ("md", "markdown") if inside else ("",):
            _refuse_hidden(files, place.suffix(f"/*.{ending}") if inside else place, spark)
    if "**" in pattern:
        _refuse_hidden_below(files, pattern, spark)
        reader = reader.option("recursiveFileLookup", True)
    elif "*" not in pattern and files.exists(place) and files.getFileStatus(place).isDirectory():
        reader = reader.option("pathGlobFilter", "*.{md,markdown}")
    try:
        rows = reader.text(pattern.split("**")[0] or ".", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # Paths read as the pattern was written: relative ones stay relative.
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if "://" not in pattern:
        path = F.regexp_replace(path, r"^[a-z0-9]+:(?://[^/]*)?", "")
        if not pattern.startswith("/"):
            here = files.getWorkingDirectory().toUri().getPath().rstrip("/") + "/"
            path = F.when(path.startswith(here), F.substring(path, F.lit(len(here) + 1), F.length(path))).otherwise(path)
    found = rows.select(path.alias("path"), F.col("value").alias("content"))
    if "*" in pattern:  # a pattern names files, not the inside of directories it matches
        found = found.where(F.col("path").rlike(_glob_regex(pattern.removeprefix("./"))))
    return None if found.isEmpty() else found


def _glob_regex(pattern: str) -> str:
    """Regular expression of a glob: `**` any directories, `*` and `?` within one name."""
    signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", pattern)
    body = (signs.get(p) or (p.replace("[!", "[^") if p.startswith("[") else re.escape(p)) for p in pieces if p)
    return f"^{''.join(body)}$"


def markdown_table(rows: DataFrame) -> DataFrame:
    """A table of files that is already there, checked for its columns."""
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in MARKDOWN])


def url_lines(lines: DataFrame) -> DataFrame:
    """URL list from lines of text: those that start with `http`, duplicates kept."""
    return lines.where(F.col("value").startswith("http")).select(F.col("value").alias("url"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(spark.read.text(path))


def urls_in_documents(documents: DataFrame) -> DataFrame:
    """URL list from documents: the URLs of each, deduplicated in it."""
    return unfold(documents, [], urls_in("content"), "url").select("url")


def urls_of(spark: SparkSession, url: str | None = None, lines: str | None = None, document: str | None = None) -> DataFrame:
    """URLs to work on: a single one wins over a list file, a list over a document."""
    if url is not None:
        return spark.createDataFrame([(url,)], "url string")
    if lines is not None:
        return url_list(spark, lines)
    if document is None:
        raise ValueError("give a URL, a file with one URL per line, or a document")
    return urls_in_documents(spark.read.text(document, wholetext=True).withColumnRenamed("value", "content"))


def crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl snapshot.  Only the columns and rows a query needs are read."""
    return spark.read.schema(CRAWL).parquet(path)


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl snapshot from plain (url, html) rows that were fetched without trouble."""
    nothing = F.lit(None).cast("string")
    return pages.select(
        "url", F.col("url").alias("final_url"), nothing.alias("title"), "html", nothing.alias("error"),
        F.lit(1).alias("attempt"),
    )


def registry_records(spark: SparkSession, path: str) -> Registry:
    """Registry from JSON lines, one record with its `cited_in` list each.

    A line that is no record, or a status that is none, is an error.
    """
    schema = T.StructType([*REFERENCES, T.StructField("cited_in", T.ArrayType(T.StringType())), T.StructField("part", T.IntegerType())])
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    status = F.when(F.col("status").isin(fixed.STATUSES), F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("none"))))
    )
    pairs = unfold(rows, ["url", "coalesce(part, 0) AS part"], "cited_in", "path")
    return Registry(
        rows.withColumn("status", status).where("part IS NULL").drop("cited_in", "part"),
        # the place in the list is kept as the order of the files
        pairs.select("url", "path", (F.col("part") * PATHS_PER_ROW + F.col("pos")).alias("arg_no"), F.lit(0).alias("scan")),
    )


def registry_meta(spark: SparkSession, path: str) -> tuple[dt.date, dt.datetime | None]:
    """Day of creation and time of the last verification, from the one `meta` object of a registry.

    Another tool's registry, or a file that has not exactly one object, is an error.
    """
    schema = "created date, last_verified timestamp, tool string, total_links bigint"
    rows = spark.read.schema(schema).json(path, mode="FAILFAST").limit(2).collect()
    if len(rows) != 1 or rows[0].created is None or rows[0].tool != fixed.REGISTRY_TOOL:
        raise ValueError(f"no registry meta at {path}")
    return rows[0].created, rows[0].last_verified


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Extracted paper texts."""
    return spark.read.schema(TEXTDOCS).parquet(path)
