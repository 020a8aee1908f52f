"""Versioned registry in buckets, on any Spark file system, for several writers.

    <root>/versions/v000000000007.json   one line: version 7, and where its parts are
    <root>/data/<attempt>/references/bucket=3/...   rows of a bucket, sorted by URL
    <root>/data/<attempt>/cited_in/bucket=3/...     (url, path) pairs that an attempt added

A URL's bucket is its hash modulo a power of two.  A change reads and writes
only the buckets of the URLs it names; the version it makes takes the others
over as they are.  Buckets are split once they hold more than ROWS_PER_BUCKET
references on average, so what a small change reads stays the same however
large the registry gets.  Pairs are added beside the older ones; a bucket with
MOST_PARTS of such parts is written anew in one.

Every attempt has a folder of its own and its version file is published only
if there is none of that number.  So nothing that a reader may be reading is
ever overwritten, a job that is lost half-way leaves the previous version in
force, and of two writers that start from one version the second to finish
works again from what the first has made.  Publishing needs a store that can
refuse to replace a file: local disks and HDFS do.  Where renaming replaces
silently, keep to one writer.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import fixed_values as fixed
from linkloom.operators.registry import Registry, by_url, empty
from linkloom.schemas import CITED_IN, META, REFERENCES

FIRST_BUCKETS = 8
ROWS_PER_BUCKET = 1_000_000
MOST_PARTS = 16
TRIES = 20

Result = TypeVar("Result")


class RegistryExistsError(FileExistsError):
    """A registry is there already.  The text is the error record."""


class VersionTakenError(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Version:
    """What a version file says.  Of bucket k: `references[k]` is the attempt that wrote its
    references (null: none), `rows[k]` their number, `cited_in[k]` the attempts that added pairs."""

    number: int
    created: dt.date
    last_verified: dt.datetime | None
    scan: int  # number of the latest scan; pairs of later scans follow those of earlier ones
    references: tuple[str | None, ...]
    rows: tuple[int, ...]
    cited_in: tuple[tuple[str, ...], ...]

    @property
    def buckets(self) -> int:
        return len(self.rows)

    @property
    def total_links(self) -> int:
        return sum(self.rows)

    def to_json(self) -> str:
        verified = self.last_verified and self.last_verified.isoformat()
        return json.dumps({**asdict(self), "tool": fixed.REGISTRY_TOOL, "created": self.created.isoformat(), "last_verified": verified})

    @classmethod
    def from_json(cls, text: str) -> Version:
        held = json.loads(text)
        held.pop("tool")
        return cls(**{
            **held, "created": dt.date.fromisoformat(held["created"]),
            "last_verified": held["last_verified"] and dt.datetime.fromisoformat(held["last_verified"]),
            "references": tuple(held["references"]), "rows": tuple(held["rows"]), "cited_in": tuple(map(tuple, held["cited_in"])),
        })


def no_version(created: dt.date, number: int = 0, buckets: int = FIRST_BUCKETS) -> Version:
    """An empty registry that is not stored yet."""
    return Version(number, created, None, number, (None,) * buckets, (0,) * buckets, ((),) * buckets)


def bucket(url: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


class RegistryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions --------------------------------------------------------------------

    def _path(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        files, path = self._path("versions/v*.json")
        return sorted(int(s.getPath().getName()[1:-5]) for s in files.globStatus(path) or [])

    def _place(self, number: int) -> str:
        return f"versions/v{number:012}.json"

    def version(self, number: int) -> Version:
        return Version.from_json(self.spark.read.text(f"{self.root}/{self._place(number)}").first().value)

    def latest(self) -> Version | None:
        """The version in force; one small file, whatever the registry holds."""
        numbers = self._numbers()
        return self.version(numbers[-1]) if numbers else None

    def _required(self, number: int | None = None) -> Version:
        found = self.latest() if number is None else self.version(number)
        if found is None:
            raise FileNotFoundError(f"no registry at {self.root}")
        return found

    def meta(self, version: int | None = None) -> DataFrame:
        held = self._required(version)
        row = (held.number, held.created, held.last_verified, fixed.REGISTRY_TOOL, held.total_links)
        return self.spark.createDataFrame([row], META)

    def publish(self, version: Version) -> None:
        """Put a version in force, unless there is one of its number already."""
        files, target = self._path(self._place(version.number))
        _, draft = self._path(f"versions/.draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(version.to_json().encode())
        stream.close()
        try:
            if files.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, target, options)
        except (FileExistsError, Py4JJavaError) as error:
            if isinstance(error, Py4JJavaError) and "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise VersionTakenError(f"version {version.number} of {self.root} is taken") from error
        finally:
            files.delete(draft, False)

    def change(self, job: Callable[[Version | None], tuple[Version | None, Result]]) -> Result:
        """Run a job on the version in force and publish what it makes of it.

        If another writer has been faster, the job runs again on that one's
        version.  A job that makes no version changes nothing.
        """
        for _ in range(TRIES):
            made, result = job(self.latest())
            if made is None:
                return result
            try:
                self.publish(made)
                return result
            except VersionTakenError:
                continue
        raise VersionTakenError(f"{TRIES} other writers of {self.root} were faster")

    # --- rows -------------------------------------------------------------------------

    def part(self, held: Version, buckets: Iterable[int] | None = None) -> Registry:
        """Rows of some buckets, by default of all, in no order.  Other buckets are not opened."""
        chosen = range(held.buckets) if buckets is None else sorted(buckets)
        references = [self._bucket_place(held.references[k], "references", k) for k in chosen if held.references[k]]
        pairs = [self._bucket_place(attempt, "cited_in", k) for k in chosen for attempt in held.cited_in[k]]
        nothing = empty(self.spark)
        return Registry(
            self.spark.read.schema(REFERENCES).parquet(*references) if references else nothing.references,
            self.spark.read.schema(CITED_IN).parquet(*pairs) if pairs else nothing.cited_in,
        )

    def _bucket_place(self, attempt: str, table: str, k: int) -> str:
        return f"{self.root}/data/{attempt}/{table}/bucket={k}"

    def read(self, version: int | None = None) -> Registry:
        """Registry of a version, by default of the latest, in the order of URLs; an empty one if there is none."""
        if version is None and not self._numbers():
            return empty(self.spark)
        rows = self.part(self._required(version))
        return Registry(by_url(rows.references), rows.cited_in)

    def named(self, held: Version, urls: DataFrame) -> list[int]:
        """Buckets of the URLs."""
        found = urls.select(bucket("url", held.buckets).alias("bucket")).distinct().collect()  # a row per bucket at most
        return sorted(r.bucket for r in found)

    def grown(self, held: Version) -> int:
        """How many buckets the next version should have."""
        buckets = held.buckets
        while held.total_links > buckets * ROWS_PER_BUCKET:
            buckets *= 2
        return buckets

    def _write(self, rows: DataFrame, buckets: int, attempt: str, table: str, order: list[str]) -> DataFrame:
        """Rows into their buckets.  Tasks share them out by URL and file, so a crowded bucket has many."""
        place = f"{self.root}/data/{attempt}/{table}"
        spread = rows.withColumn("bucket", bucket("url", buckets))
        spread = spread.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        spread.write.partitionBy("bucket").parquet(place)
        return self.spark.read.schema(spread.schema).parquet(place)

    def store(
        self, held: Version, references: DataFrame, pairs: DataFrame | None = None, named: Iterable[int] | None = None,
        buckets: int | None = None, whole_pairs: Iterable[int] = (), **news,
    ) -> tuple[Version, DataFrame]:
        """Write a change of `held`, without publishing it: the version it makes, and the references as written.

        `references` are all rows of the `named` buckets (by default of all),
        `pairs` what is added to `cited_in` there; in buckets of `whole_pairs`
        they replace the older parts.  `news` are fields of the version.
        """
        attempt, buckets = uuid.uuid4().hex, buckets or held.buckets
        named = set(range(buckets)) if named is None else set(named)
        written = self._write(references, buckets, attempt, "references", ["url"])
        rows = {r.bucket: r["count"] for r in written.groupBy("bucket").count().collect()}  # a row per bucket
        added: set[int] = set()
        if pairs is not None:
            kept = self._write(pairs.select("url", "path", "arg_no", "scan"), buckets, attempt, "cited_in", ["url", "path"])
            added = {r.bucket for r in kept.select("bucket").distinct().collect()}
        older = held.cited_in if buckets == held.buckets else ((),) * buckets
        whole = set(whole_pairs)
        made = replace(
            held, number=held.number + 1,
            references=tuple((attempt if rows.get(k) else None) if k in named else held.references[k] for k in range(buckets)),
            rows=tuple(rows.get(k, 0) if k in named else held.rows[k] for k in range(buckets)),
            cited_in=tuple((() if k in whole else older[k]) + ((attempt,) if k in added else ()) for k in range(buckets)),
            **news,
        )
        return made, written

    # --- whole registries ----------------------------------------------------------------

    def replace_with(self, registry: Registry, created: dt.date, last_verified: dt.datetime | None = None) -> Callable:
        """A job for `change` that puts a whole registry in force in place of what there was."""

        def job(held: Version | None) -> tuple[Version, Version]:
            count = registry.references.count()
            start = no_version(created, held.number if held else 0)
            while count > start.buckets * ROWS_PER_BUCKET:
                start = no_version(created, start.number, 2 * start.buckets)
            made, _ = self.store(start, registry.references, registry.cited_in, last_verified=last_verified, scan=start.number + 1)
            return made, made

        return job

    def create(self, today: dt.date, force: bool = False) -> Version:
        """New registry with one example; refuses to replace one unless forced."""
        example = (fixed.EXAMPLE_URL, fixed.EXAMPLE_TITLE, [fixed.EXAMPLE_CATEGORY], "pending", None, None)
        pair = (fixed.EXAMPLE_URL, fixed.EXAMPLE_FILE, 0, 0)
        rows = Registry(self.spark.createDataFrame([example], REFERENCES), self.spark.createDataFrame([pair], CITED_IN))
        replaced = self.replace_with(rows, today)

        def job(held: Version | None) -> tuple[Version, Version]:
            if held is not None and not force:
                message = f"{self.root} already exists. Use force to overwrite."
                raise RegistryExistsError(json.dumps({"error": "file_exists", "message": message, "file": self.root}))
            return replaced(held)

        return self.change(job)
