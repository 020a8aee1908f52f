"""Files named by patterns, listed and read in tasks.

Directories are rows.  A level of the tree is one job: every task lists some
directories and reports the files that the pattern names and the directories
to go on with.  The driver only counts levels; it sees no file.  Listing goes
directory by directory, so names that begin with `_` or `.`, which Spark's own
readers pass over, are found like all others.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.staging import staged

# Executors need no copy of this package: the functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stores that tasks can open by themselves, and what they are called there.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
BATCH_BYTES = 4 << 20
_MAGIC = re.compile(r"[*?\[]")
_MARKDOWN = r".+\.(?:md|markdown)"
_STEPS = "place string, shown string, step int, is_file boolean"


def name_regex(part: str) -> str:
    """Regular expression of one part of a pattern: `*` and `?` stand for characters of one name."""
    signs = {"*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*|\?|\[[^\]]*\])", part)
    return "".join(signs.get(p) or (p.replace("[!", "[^") if p.startswith("[") else re.escape(p)) for p in pieces if p)


@dataclass(frozen=True)
class Search:
    """A pattern: where to begin, under which name to show it, and what each level must look like (None: `**`)."""

    store: str
    place: str
    shown: str
    parts: tuple[str | None, ...]


def search(spark: SparkSession, pattern: str) -> Search | None:
    """The search that a pattern asks for, null if its store can't be opened in tasks."""
    pattern = pattern.removeprefix("./")
    pieces = pattern.split("/")
    fixed = next((i for i, p in enumerate(pieces) if _MAGIC.search(p)), len(pieces))
    shown = "/".join(pieces[:fixed])
    path = spark._jvm.org.apache.hadoop.fs.Path(shown or ("/" if pattern.startswith("/") else "."))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = files.makeQualified(path).toUri()
    if uri.getScheme() not in STORES:
        return None
    store = f"{STORES[uri.getScheme()]}://{uri.getAuthority() or ''}/"
    if fixed == len(pieces):  # one file, or the files of one directory
        inside = files.exists(path) and files.getFileStatus(path).isDirectory()
        return Search(store, uri.getPath(), shown, (_MARKDOWN,) if inside else ())
    parts = tuple(None if p == "**" else name_regex(p) for p in pieces[fixed:])
    return Search(store, uri.getPath(), shown, parts if parts[-1] is not None else (*parts, ".*"))


def _open(store: str):
    """File system of a store and what its paths begin with."""
    from pyarrow import fs

    if store == "file:///":
        return fs.LocalFileSystem(), ""
    system, root = fs.FileSystem.from_uri(store)
    return system, root.rstrip("/")


def _level(store: str, parts: tuple[str | None, ...]):
    def following(step: int) -> Iterator[int]:
        """The parts that a name at this level may match: `**` also stands for nothing."""
        yield step
        if parts[step] is None and step + 1 < len(parts):
            yield from following(step + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = _open(store)
        for batch in batches:
            for place, shown, step in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = set()
                for info in system.get_file_info(fs.FileSelector(root + place, allow_not_found=True)):
                    name, is_file = info.base_name, info.type == fs.FileType.File
                    child = f"{place.rstrip('/')}/{name}", f"{shown.rstrip('/')}/{name}" if shown else name
                    for at in following(step):
                        last = at == len(parts) - 1
                        if parts[at] is None:
                            rows |= set() if is_file else {(*child, at, False)}
                        elif is_file == last and re.fullmatch(parts[at], name):
                            rows.add((*child, at + 1, is_file))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*sorted(rows)), (pa.string(), pa.string(), pa.int32(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["place", "shown", "step", "is_file"])

    return run


def _read(store: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(store)
        names, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

        for batch in batches:
            for place, shown in zip(*(batch.column(i).to_pylist() for i in range(2))):
                with system.open_input_stream(root + place) as stream:
                    text = stream.read().decode("utf-8", "replace")
                names.append(shown)
                texts.append(text)
                held += len(text)
                if held >= BATCH_BYTES:
                    yield flush()
                    names, texts, held = [], [], 0
        if names:
            yield flush()

    return run


def listed(spark: SparkSession, wanted: Search) -> DataFrame | None:
    """(place, shown) of every file that a search finds, written once; null if it finds none."""
    if not wanted.parts:
        path = spark._jvm.org.apache.hadoop.fs.Path(wanted.shown)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path) or not files.getFileStatus(path).isFile():
            return None
        return spark.createDataFrame([(wanted.place, wanted.shown)], "place string, shown string")
    directories = spark.createDataFrame([(wanted.place, wanted.shown, 0)], "place string, shown string, step int")
    found = None
    while not directories.isEmpty():
        level = staged(directories.repartition("place", "step").mapInArrow(_level(wanted.store, wanted.parts), _STEPS).distinct())
        files = level.where("is_file").select("place", "shown")
        found = files if found is None else found.unionByName(files)
        directories = level.where("NOT is_file").select("place", "shown", "step")
    found = None if found is None else found.distinct()
    return None if found is None or found.isEmpty() else found


def contents(found: DataFrame, wanted: Search) -> DataFrame:
    """(path, content) of listed files."""
    return found.repartition("place").mapInArrow(_read(wanted.store), "path string, content string")
