"""Upkeep of a registry from streams of files and crawl rows."""

import datetime as dt

from linkloom.schemas import CRAWL, MARKDOWN
from linkloom.sources.registry_store import RegistryStore
from linkloom.streaming.upkeep import keep_scanning, keep_verifying

DAY, NOW = dt.date(2024, 1, 2), dt.datetime(2024, 5, 6, 7, 8, 9)


def test_streams_keep_a_registry(spark, tmp_path):
    root, files, crawl = (str(tmp_path / name) for name in ("registry", "files", "crawl"))

    def add(rows, schema, place):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)

    def scan():
        stream = spark.readStream.schema(MARKDOWN).parquet(files)
        keep_scanning(root, stream, str(tmp_path / "c1"), lambda: DAY, once=True).awaitTermination()

    add([("a.md", "[A](https://a.org)")], MARKDOWN, files)
    scan()
    add([("b.md", "https://a.org https://b.org"), ("c.md", "none")], MARKDOWN, files)
    scan()
    store = RegistryStore(spark, root)
    assert store.latest().number == 2
    assert sorted((r.url, r.path) for r in store.read().cited_in.collect()) == [
        ("https://a.org", "a.md"), ("https://a.org", "b.md"), ("https://b.org", "b.md"),
    ]
    add([("https://b.org", "https://b.org", "404", "x", None, 1)], CRAWL, crawl)
    stream = spark.readStream.schema(CRAWL).parquet(crawl)
    keep_verifying(root, stream, str(tmp_path / "c2"), lambda: NOW, once=True).awaitTermination()
    assert {r.url: r.status for r in store.read().references.collect()} == {"https://a.org": "pending", "https://b.org": "dead"}
