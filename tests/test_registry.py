"""Scans, upserts, verification and the registry store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkloom.operators import citations, facts, health, pages, registry, rollups, snapshot
from linkloom.operators.snapshot import UrlList, first_attempts
from linkloom.plans import commands
from linkloom.sources.readers import HiddenFilesError, NoFilesError, crawl, registry_records, markdown_files, markdown_table, url_list, urls_of
from linkloom.sources.records import json_lines, write_json_lines
from linkloom.sources import listing, registry_store
from linkloom.sources.registry_store import RegistryExistsError, RegistryStore, Version, VersionTakenError

DAY = dt.date(2024, 1, 2)
NOW = dt.datetime(2024, 5, 6, 7, 8, 9)
CRAWL_ROW = "url string, final_url string, title string, html string, error string, attempt int"


def _files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def _refs(df):
    return {r.url: r for r in df.collect()}


def _pairs(registry_):
    return sorted((r.url, r.path) for r in registry_.cited_in.collect())


def _merge(spark, held, scan, *rows):
    return registry.merge(held, citations.cited_in(citations.citations(_files(spark, *rows))), scan)


def test_references_take_first_file_and_first_real_title(spark):
    found = citations.cited_in(
        citations.citations(
            _files(
                spark,
                ("research/b.md", "[Real](https://x.org) https://x.org"),
                ("docs/a.md", "https://x.org [https://x.org](https://x.org)"),
                ("zz.md", "[Late](https://x.org) https://y.org"),
            )
        )
    )
    rows = _refs(citations.references(found))
    assert (rows["https://x.org"].title, rows["https://x.org"].categories, rows["https://x.org"].cited_by) == (
        "Real", ["documentation"], 3,
    )
    assert (rows["https://y.org"].title, rows["https://y.org"].categories) == ("https://y.org", ["general"])


def test_upsert_rules_and_counters(spark):
    held = _merge(spark, registry.empty(spark), 1, ("docs/a.md", "https://x.org [Own](https://t.org)"))
    after = _merge(
        spark, held, 2,
        ("docs/a.md", "https://x.org"), ("new/b.md", "[X](https://x.org) [Other](https://t.org) https://n.org"),
        ("new/c.md", "https://x.org"),
    )
    rows = _refs(after.references)
    assert rows["https://x.org"].title == "X"  # was the bare URL
    assert rows["https://t.org"].title == "Own"  # a real title stays
    assert rows["https://x.org"].categories == ["documentation"]
    assert (rows["https://n.org"].is_new, rows["https://n.org"].status) == (True, "pending")
    assert (rows["https://x.org"].appended, rows["https://t.org"].appended) == (2, 1)
    assert tuple(rollups.scan_totals(after.references).first()) == (3, 1, 3)
    assert _pairs(after) == [
        ("https://n.org", "new/b.md"), ("https://t.org", "docs/a.md"), ("https://t.org", "new/b.md"),
        ("https://x.org", "docs/a.md"), ("https://x.org", "new/b.md"), ("https://x.org", "new/c.md"),
    ]


def test_second_scan_changes_nothing(spark):
    rows = [("docs/a.md", "https://x.org [T](https://t.org)"), ("docs/b.md", "https://x.org")]
    once = _merge(spark, registry.empty(spark), 1, *rows)
    twice = _merge(spark, once, 2, *rows)
    assert tuple(rollups.scan_totals(twice.references).first()) == (2, 0, 0)
    assert _pairs(once) == _pairs(twice)
    columns = ["url", "title", "categories", "status"]
    assert sorted(once.references.select(columns).collect()) == sorted(twice.references.select(columns).collect())


def test_file_listed_twice_is_cited_once(spark):
    row = ("a.md", "https://x.org")
    assert _pairs(_merge(spark, registry.empty(spark), 1, row, row)) == [("https://x.org", "a.md")]


def test_nested_keeps_every_file_of_a_crowded_url(spark):
    files = spark.range(500).selectExpr("concat('f', id, '.md') AS path", "if(id % 3 = 0, 'https://hot.org', concat('https://c.org/', id % 50)) AS content")
    held = registry.merge(registry.empty(spark), citations.cited_in(citations.citations(files)), 1)
    rows = registry.nested(held, paths_per_row=20).collect()
    hot = sorted((r.part, r.cited_in) for r in rows if r.url == "https://hot.org")
    assert [part for part, _ in hot] == list(range(9)) and [len(files) for _, files in hot] == [20] * 8 + [7]
    assert [p for _, files in hot for p in files] == sorted(f"f{n}.md" for n in range(0, 500, 3))
    cold = [r for r in rows if r.url != "https://hot.org"]
    assert len(cold) == 50 and all(r.part == 0 and r.cited_in == sorted(r.cited_in) for r in cold)


def _written(tmp_path, *names):
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)


def test_files_with_any_name_are_read(spark, tmp_path):
    names = ["a.md", "_index.md", ".x.md", "_drafts/e.md", "sub/.git/deep/f.md", "sub/b.md", "k/_y=1/d.md", "sub/c.markdown", "sub/_n.txt", ".md"]
    _written(tmp_path, *names)

    def found(*patterns):
        rows = markdown_files(spark, [f"{tmp_path}/{p}" for p in patterns]).collect()
        assert all(r.path == f"{tmp_path}/{r.content}" for r in rows)
        return sorted(r.content for r in rows)

    assert found("") == [".x.md", "_index.md", "a.md"]  # `.md` is a name without ending
    assert found("*.md") == [".md", ".x.md", "_index.md", "a.md"]
    assert found("_index.md", "sub/.git/deep/f.md") == ["_index.md", "sub/.git/deep/f.md"]
    assert found("**/*.md") == sorted(n for n in names if n.endswith(".md"))
    assert found("s*/**/*.md") == ["sub/.git/deep/f.md", "sub/b.md"]
    assert found("**/_*/**/*.md") == ["_drafts/e.md", "k/_y=1/d.md"]
    assert found("**") == sorted(names) and found("sub/**/**/?.m[!x]") == ["sub/.git/deep/f.md", "sub/b.md"]
    assert [r.path for r in markdown_files(spark, [f"file://{tmp_path}/_dr*/*.md"]).collect()] == [f"file://{tmp_path}/_drafts/e.md"]


def test_relative_patterns_keep_relative_paths(spark, tmp_path, monkeypatch):
    import os

    _written(tmp_path, "docs/_a.md", "docs/sub/b.md")
    here = os.path.relpath(tmp_path)
    assert sorted(r.path for r in markdown_files(spark, [f"{here}/docs/**/*.md"]).collect()) == [f"{here}/docs/_a.md", f"{here}/docs/sub/b.md"]


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    _written(tmp_path, *(f"d{n % 40}/s{n % 7}/f{n}.md" for n in range(400)))
    jobs = []
    level = listing._level
    monkeypatch.setattr(listing, "_level", lambda *a: jobs.append(a) or level(*a))
    assert markdown_files(spark, [f"{tmp_path}/**/*.md"]).count() == 400
    assert len(jobs) == 3  # one per level, not one per directory


def test_stores_that_tasks_cannot_open_lose_no_file_in_silence(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "STORES", {})
    _written(tmp_path, "a.md", "sub/b.md")
    assert markdown_files(spark, [str(tmp_path)]).count() == 1 and markdown_files(spark, [f"{tmp_path}/**/*.md"]).count() == 2
    with pytest.raises(NoFilesError):
        markdown_files(spark, [f"{tmp_path}/none/**/*.md"])
    _written(tmp_path, "_index.md", "sub/.hidden.md")
    for pattern in ("", "/*.md", "/_index.md", "/sub/**/*.md"):
        with pytest.raises(HiddenFilesError):
            markdown_files(spark, [f"{tmp_path}{pattern}"])


def test_the_least_attempt_counts(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 1), ("d", 5)]
    crawl = spark.createDataFrame([(u, n, f"{u}{n}") for u, n in rows], "url string, attempt int, title string")
    assert sorted(r.title for r in first_attempts(crawl).collect()) == ["a1", "b2", "c1", "d5"]


def test_a_list_passes_few_other_rows(spark):
    urls = spark.range(2000).selectExpr("concat('u', id) AS url")
    crawl = spark.range(40_000).selectExpr("concat('u', id) AS url")
    left = {r.url for r in UrlList(urls).restrict(crawl).collect()}
    assert {f"u{n}" for n in range(2000)} <= left and len(left) < 2400


def test_a_long_list_passes_few_other_rows(spark, monkeypatch):
    urls = spark.range(300_000).selectExpr("concat('u', id) AS url")
    crawl = spark.range(3_000_000).selectExpr("concat('u', id * 3) AS url", "id AS n")
    passed = UrlList(urls).restrict(crawl)
    assert 100_000 <= passed.count() < 200_000  # of 2,900,000 others less than one in 29
    monkeypatch.setattr(snapshot, "MOST_WORDS", 1 << 10)
    exact = UrlList(urls).restrict(crawl)  # too long for the largest filter
    assert exact.columns == crawl.columns and exact.count() == 100_000


def test_attach_copies_a_hot_result_in_slices(spark):
    urls = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', concat('c', id)) AS url")
    results = spark.createDataFrame([("hot", 1), ("c1", 2), ("other", 3)], "url string, n int")
    rows = UrlList(urls).attach(results, copies_per_slice=7).collect()
    assert len(rows) == 1000
    assert sum(r.n == 1 for r in rows) == 334 and [r.url for r in rows if r.n == 2] == ["c1"]
    assert {r.url for r in rows} == {r.url for r in urls.collect()}
    assert sorted(rows) == sorted(UrlList(urls).attach(results).collect())
    assert {"c1", "hot"} <= {r.url for r in UrlList(urls).restrict(results).collect()}
    assert UrlList(urls.limit(0)).attach(results).collect() == []


def test_verdict_cascade_and_selected_update(spark):
    pages = spark.createDataFrame(
        [
            ("https://a.org", "https://a.org", "ok", "fine", None), ("https://b.org", "https://b.org", "Not Found", "x", None),
            ("https://c.org", "https://d.org", "ok", "paywall", None), ("https://e.org", "https://www.e.org", "403", "Paywall", None),
            ("https://f.org", "https://f.org", "ok", "please log in", None), ("https://g.org", "https://h.org", "ok", "x", "Navigation timeout"),
            ("https://i.org", "https://i.org", "ok", None, None), ("https://j.org", "https://k.org", "Fortune 500", "x", None),
        ],
        "url string, final_url string, title string, html string, error string",
    )
    got = {r.url: (r.status, r.notes) for r in health.verify(pages).collect()}
    assert got == {
        "https://a.org": ("ok", None), "https://b.org": ("dead", "HTTP 404"), "https://c.org": ("redirect", "https://d.org"),
        "https://e.org": ("paywall", "Paywall detected"), "https://f.org": ("login", "Login required"),
        "https://g.org": ("dead", "Navigation timeout"), "https://i.org": ("ok", None), "https://j.org": ("dead", "HTTP 500"),
    }
    old = dt.datetime(2020, 1, 1)
    held = spark.createDataFrame(
        [
            ("https://a.org", "A", ["api", "x"], "dead", old, "HTTP 404"), ("https://b.org", "B", ["docs"], "ok", old, None),
            ("https://zz.org", "Z", ["api"], "login", old, "Login required"),
        ],
        "url string, title string, categories array<string>, status string, verified timestamp, notes string",
    )
    from pyspark.sql import functions as F

    rows = _refs(registry.apply_verdicts(held, health.verify(pages), F.lit(NOW), ["api"]))
    assert tuple(rows["https://a.org"])[3:] == ("ok", NOW, None, True)
    assert tuple(rows["https://b.org"])[3:] == ("ok", old, None, False)  # not selected
    assert tuple(rows["https://zz.org"])[3:] == ("login", old, "Login required", False)  # not crawled
    totals = rollups.verify_totals(registry.apply_verdicts(held, health.verify(pages), F.lit(NOW), ["api"])).first()
    assert totals.asDict() == {
        "total": 3, "verified": 1, "ok": 1, "dead": 0, "redirect": 0, "paywall": 0, "login": 0, "skipped": 2,
    }


def test_link_retry_and_redirect(spark):
    pages = spark.createDataFrame(
        [
            ("a", "a", "ok", "timeout", 1), ("a", "a", "ok", None, 2), ("b", "b", "ok", "x", 1), ("b", "b", "ok", "y", 2),
            ("b", "b", "ok", None, 3), ("https://c.org", "https://d.org", "ok", None, 1),
            ("https://e.org", "https://f.org", "404", None, 1), ("https://e.org", "https://e.org", "ok", None, 2),
        ],
        "url string, final_url string, title string, error string, attempt int",
    )
    got = {r.url: tuple(r)[1:] for r in health.link_results(pages).collect()}
    assert got == {
        "a": (200, None, None, True), "b": (0, "y", None, False), "https://c.org": (200, None, "https://d.org", False),
        "https://e.org": (404, None, None, False),
    }
    assert {r.url: r.status for r in health.link_results(pages, retries=0).collect()}["a"] == 0


def test_facts_of_a_failed_navigation_still_succeed(spark):
    pages = spark.createDataFrame(
        [
            ("https://instagram.com/nasa/", "577K Followers $5", None), ("https://techcrunch.com/x", "<title>T</title> $3 billion 4%", "net::ERR"),
            ("https://www.statista.com/1", None, "net::ERR"),
        ],
        "url string, html string, error string",
    )
    urls = spark.createDataFrame(
        [("https://techcrunch.com/x", "market"), ("https://instagram.com/nasa/", "instagram"), ("https://www.statista.com/1", "statista"), ("https://no.org", "market")],
        "url string, type string",
    )
    rows = _refs(facts.refresh(urls, pages))
    assert (rows["https://techcrunch.com/x"].type, rows["https://techcrunch.com/x"].success) == ("generic", True)
    assert (rows["https://instagram.com/nasa/"].followers, rows["https://instagram.com/nasa/"].username, rows["https://instagram.com/nasa/"].amounts) == ("577K", "nasa", None)
    assert (rows["https://www.statista.com/1"].success, rows["https://www.statista.com/1"].error) == (False, "net::ERR")
    assert rows["https://no.org"].error == "Not crawled"
    assert tuple(rollups.fact_totals(facts.refresh(urls, pages)).first()) == (2, 2)


def test_violations(spark):
    refs = spark.createDataFrame(
        [
            ("https://a.org", "A", ["x"], "ok"), ("no uri", "", [], "gone"), ("https://b.org", None, None, None), (None, "N", ["x"], "ok"),
        ],
        "url string, title string, categories array<string>, status string",
    )
    cited = spark.createDataFrame([("https://a.org", "f"), ("no uri", "f")], "url string, path string")
    meta = spark.createDataFrame([(DAY, "ref", 4), (None, "x", -1)], "created date, tool string, total_links bigint")
    got = sorted((r.url or "", r.rule) for r in registry.violations(registry.Registry(refs, cited), meta).collect())
    assert got == sorted(
        [("no uri", r) for r in ("url_format", "title_empty", "categories_empty", "status_unknown")]
        + [("https://b.org", r) for r in ("title_required", "categories_required", "status_required", "cited_in_empty")]
        + [("", r) for r in ("url_required", "cited_in_empty", "created_required", "tool_unknown", "total_links_negative")]
    )


def test_store_round_trip(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"))
    assert store.latest() is None
    store.create(DAY)
    with pytest.raises(RegistryExistsError):
        store.create(DAY)
    with pytest.raises(RegistryExistsError, match="file_exists"):
        store.create(DAY)
    (example,) = store.read().references.collect()
    assert (example.url, example.status, _pairs(store.read())) == ("https://example.com", "pending", [("https://example.com", "README.md")])

    files = _files(spark, ("docs/a.md", "[X](https://x.org) https://example.com"), ("docs/b.md", "https://x.org"))
    report = commands.scan(store, files, dt.date(2025, 1, 1)).first()
    assert (report.scanned_files, report.total_urls, report.new_urls, report.updated_urls) == (2, 2, 1, 1)
    assert store.latest().created == DAY
    assert len(_pairs(store.read())) == 4 and len(_pairs(store.read(version=1))) == 1
    again = commands.scan(store, files, DAY).first()
    assert (again.new_urls, again.updated_urls) == (0, 0)

    pages = spark.createDataFrame([("https://x.org", "https://x.org", "404", "x", None, 1)], "url string, final_url string, title string, html string, error string, attempt int")
    number = store.latest().number
    dry = commands.verify_references(store, pages, NOW, dry_run=True).first()
    assert (dry.summary.dead, dry.summary.skipped, store.latest().number) == (1, 1, number)
    assert commands.verify_references(store, pages, NOW, wanted=["nope"]).first() is None
    assert store.latest().number == number
    wet = commands.verify_references(store, pages, NOW, wanted=["documentation"]).first()
    assert (wet.summary.dead, wet.summary.verified, wet.timestamp) == (1, 1, NOW)
    rows = _refs(store.read().references)
    assert (rows["https://x.org"].status, rows["https://x.org"].notes, rows["https://x.org"].verified) == ("dead", "HTTP 404", NOW)
    assert rows["https://example.com"].status == "pending"
    meta = store.meta().first()
    assert (meta.last_verified, meta.total_links, meta.tool) == (NOW, 2, "ref")
    assert registry.violations(store.read(), store.meta()).isEmpty()
    assert [r.url for r in store.read().references.collect()] == ["https://example.com", "https://x.org"]

    fresh = commands.scan(store, _files(spark, ("z.md", "https://z.org")), dt.date(2025, 2, 2), fresh=True).first()
    assert (fresh.total_urls, store.latest().created) == (1, dt.date(2025, 2, 2))
    assert _pairs(store.read()) == [("https://z.org", "z.md")]
    store.create(DAY, force=True)
    assert [r.url for r in store.read().references.collect()] == ["https://example.com"]


def test_lost_scan_leaves_the_old_version(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"))
    store.create(DAY)
    left_over = spark.createDataFrame([("https://lost.org", "l.md", 0, 2)], "url string, path string, arg_no int, scan int")
    store.store(store.latest(), store.read().references, left_over)  # and then the job dies
    assert _pairs(store.read()) == [("https://example.com", "README.md")]
    commands.scan(store, _files(spark, ("a.md", "https://a.org")), DAY)
    assert [u for u, _ in _pairs(store.read())] == ["https://a.org", "https://example.com"]


def test_two_writers_from_one_version_keep_both(spark, tmp_path, monkeypatch):
    store = RegistryStore(spark, str(tmp_path / "registry"))
    store.create(DAY)
    publish, rivals = RegistryStore.publish, [("b.md", "[B](https://b.org) https://x.org"), ("c.md", "https://x.org")]

    def late(self, version):
        if rivals:  # another writer is done while this one still writes
            commands.scan(RegistryStore(spark, self.root), _files(spark, rivals.pop(0)), DAY)
        publish(self, version)

    monkeypatch.setattr(RegistryStore, "publish", late)
    report = commands.scan(store, _files(spark, ("a.md", "[A](https://a.org) https://x.org")), DAY).first()
    assert _pairs(store.read()) == [
        ("https://a.org", "a.md"), ("https://b.org", "b.md"), ("https://example.com", "README.md"),
        ("https://x.org", "a.md"), ("https://x.org", "b.md"), ("https://x.org", "c.md"),
    ]
    assert (report.total_urls, report.new_urls, report.updated_urls) == (4, 1, 1)  # counted on what the others had made
    assert store.latest().number == 4 and len(_pairs(store.read(version=2))) == 2
    rivals += [("d.md", "https://d.org")]
    crawled = spark.createDataFrame([("https://x.org", "https://x.org", "404", "x", None, 1)], CRAWL_ROW)
    commands.verify_references(store, crawled, NOW)
    rows = _refs(store.read().references)
    assert (rows["https://x.org"].status, rows["https://d.org"].status) == ("dead", "pending")


def test_a_version_is_published_once(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"))
    held = store.create(DAY)
    with pytest.raises(VersionTakenError):
        store.publish(held)
    assert store.latest() == held and Version.from_json(held.to_json()) == held


def test_a_small_scan_reads_a_bounded_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry_store, "ROWS_PER_BUCKET", 50)
    read = []
    for n in (300, 3000):
        store = RegistryStore(spark, str(tmp_path / f"registry{n}"))
        files = spark.range(n).selectExpr("concat('f', id % 7, '.md') AS path", "concat('[T](https://x.org/', id, ')') AS content")
        commands.scan(store, files.groupBy("path").agg(F.array_join(F.collect_list("content"), " ").alias("content")), DAY)
        commands.scan(store, _files(spark, ("g.md", "https://x.org/1")), DAY)  # more rows than a bucket should have: they are split
        held = store.latest()
        assert held.total_links == n and held.buckets * 50 >= n
        before = store.part(held).references.inputFiles()
        opened = []
        part = RegistryStore.part
        with monkeypatch.context() as patch:
            patch.setattr(RegistryStore, "part", lambda self, v, b=None: opened.append((v, list(b))) or part(self, v, b))
            report = commands.scan(store, _files(spark, ("h.md", "https://x.org/1 https://new.org")), DAY).first()
        assert (report.total_urls, report.new_urls, report.updated_urls) == (n + 1, 1, 1)
        ((version, named),) = opened
        assert len(named) <= 2
        read.append(sum(version.rows[k] for k in named))
        kept = set(before) & set(store.part(store.latest()).references.inputFiles())
        assert len(kept) >= len(before) - 2 * 4  # files of all other buckets are taken over
        assert len(_refs(store.read().references)) == n + 1
    assert max(read) <= 2 * 100


def test_many_small_scans_leave_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commands, "MOST_PARTS", 3)
    store = RegistryStore(spark, str(tmp_path / "registry"))
    for n in range(6):
        commands.scan(store, _files(spark, (f"f{n}.md", "https://x.org")), DAY)
    held = store.latest()
    assert max(map(len, held.cited_in)) <= 3
    assert _pairs(store.read()) == [("https://x.org", f"f{n}.md") for n in range(6)]
    nested = registry.nested(store.read()).first()
    assert nested.cited_in == [f"f{n}.md" for n in range(6)]  # in the order of scans


def test_records_out_in_out(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"))
    commands.scan(store, _files(spark, ("b.md", "[A](https://a.org) https://x.org"), ("a.md", "https://x.org")), DAY)
    commands.scan(store, _files(spark, ("0.md", "https://x.org https://y.org")), DAY)
    crawled = spark.createDataFrame([("https://x.org", "https://x.org", "404", "x", None, 1)], CRAWL_ROW)
    commands.verify_references(store, crawled, NOW)
    places = [[str(tmp_path / f"{name}{i}") for name in ("records", "meta")] for i in range(2)]
    commands.export_records(store, *places[0])
    other = RegistryStore(spark, str(tmp_path / "other"))
    commands.import_records(other, *places[0])
    commands.export_records(other, *places[1])
    lines = [[[r.value for r in spark.read.text(place).collect()] for place in pair] for pair in places]
    assert lines[0] == lines[1] and len(lines[0][0]) == 3 and '"cited_in":["a.md","b.md","0.md"]' in lines[0][0][1]
    assert lines[0][1] == ['{"created":"2024-01-02","last_verified":"2024-05-06T07:08:09.000000+00:00","tool":"ref","total_links":3}']
    assert (other.latest().created, other.latest().last_verified) == (DAY, NOW)
    report = commands.scan(other, _files(spark, ("a.md", "https://x.org")), DAY).first()
    assert (report.new_urls, report.updated_urls) == (0, 0)
    commands.import_records(other, places[1][0], today=DAY)  # replaces what there was
    assert other.latest().last_verified is None and other.latest().total_links == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "meta").write_text('{"created":"2024-01-02","tool":"other"}')
    with pytest.raises(ValueError):
        commands.import_records(other, places[1][0], str(tmp_path / "bad"))


def test_markdown_sources(spark, tmp_path, monkeypatch):
    for name in ("docs/a.md", "docs/b.markdown", "docs/c.txt", "docs/sub/d.md", "docs/sub/deep/e.md", "docs/with blank+plus.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"{name}\nhttps://x.org/{len(name)}")
    root = str(tmp_path)

    def names(*patterns):
        return sorted(r.path.removeprefix(root + "/") for r in markdown_files(spark, [f"{root}/{p}" for p in patterns]).collect())

    assert names("docs") == ["docs/a.md", "docs/b.markdown", "docs/with blank+plus.md"]
    assert names("docs/*") == ["docs/a.md", "docs/b.markdown", "docs/c.txt", "docs/with blank+plus.md"]
    assert names("docs/*.md", "docs/a.md", "none.md") == ["docs/a.md", "docs/a.md", "docs/with blank+plus.md"]
    assert names("docs/**/*.md") == ["docs/a.md", "docs/sub/d.md", "docs/sub/deep/e.md", "docs/with blank+plus.md"]
    assert names("docs/*/*.md") == ["docs/sub/d.md"]
    files = markdown_files(spark, [f"{root}/docs/c.txt", f"{root}/docs/a.md"])
    assert {r.path[-5:]: r.arg_no for r in files.collect()} == {"c.txt": 0, "/a.md": 1}
    assert markdown_table(files).columns == ["path", "content"]
    with pytest.raises(NoFilesError, match="no_files"):
        markdown_files(spark, [f"{root}/none"])


def test_url_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("https://a.org\n# no\nhttps://a.org\nftp://x\nhttp://b.org\n")
    (tmp_path / "doc.md").write_text("see https://c.org, https://c.org and http://d.org.")
    assert [r.url for r in url_list(spark, str(tmp_path / "list.txt")).collect()] == ["https://a.org", "https://a.org", "http://b.org"]
    assert [r.url for r in urls_of(spark, document=str(tmp_path / "doc.md")).collect()] == ["https://c.org", "http://d.org"]
    assert [r.url for r in urls_of(spark, url="x", lines="y", document="z").collect()] == ["x"]
    with pytest.raises(ValueError):
        urls_of(spark)


def test_crawl_source_prunes_and_pushes_down(spark, tmp_path):
    place = str(tmp_path / "crawl")
    spark.createDataFrame([("u", "u", "t", "<p>", None, 1)], "url string, final_url string, title string, html string, error string, attempt int").write.parquet(place)
    plan = health.link_results(crawl(spark, place))._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][-1]
    assert "html" not in scan.split("ReadSchema")[1]


def test_attempts_go_by_order_not_by_number(spark):
    rows = [
        ("three", "t", "ok", "<p>", None, 3), ("late", "l", "ok", "<p>", "timeout", 4), ("late", "l", "404", "<p>", None, 9),
        ("late", "l", "ok", "<p>", None, 10), ("twice", "t", "ok", "<p>", "x", 2), ("twice", "t", "ok", "<p>", "x", 2), ("twice", "t", "ok", "<p>", None, 7),
    ]
    crawled = spark.createDataFrame(rows, CRAWL_ROW)
    assert {r.url: r.status for r in health.link_results(crawled).collect()} == {"three": 200, "late": 404, "twice": 200}
    assert {r.url: r.status for r in health.link_results(crawled, retries=0).collect()} == {"three": 200, "late": 0, "twice": 0}
    assert {r.url: r.status for r in health.verify(crawled).collect()} == {"three": "ok", "late": "dead", "twice": "dead"}
    listed = spark.createDataFrame([("three",), ("none",)], "url string")
    assert {r.url: r.status for r in health.check_links(listed, crawled).collect()} == {"three": 200, "none": 0}


def test_the_row_that_counts_does_not_depend_on_the_order_of_rows(spark):
    rows = [("u", "u", t, f"<h1>{t}</h1>", None, 1) for t in "abcdef"]
    listed = spark.createDataFrame([("u",), ("u",)], "url string")
    found = set()
    for turn in (rows, rows[::-1], rows[3:] + rows[:3]):
        crawled = spark.createDataFrame(turn, CRAWL_ROW).repartition(3)
        (record,) = {(r.title, r.status) for r in pages.fetch(crawled, listed).collect()}
        (fact,) = {r.title for r in facts.refresh(listed, crawled).collect()}
        assert fact == record[0]  # one row, whatever is asked of it
        found.add(record)
    assert len(found) == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_parse_no_page_and_run_no_pattern(spark, tmp_path):
    place = str(tmp_path / "crawl")
    spark.createDataFrame([("https://u.org", "https://u.org", "t", "<p>$5 up 3%", None, 1)], CRAWL_ROW).write.parquet(place)
    listed = spark.createDataFrame([("https://u.org",)], "url string")
    records = pages.fetch(crawl(spark, place), listed)
    assert "_elements" in _plan(records) and "_elements" not in _plan(rollups.record_totals(records))
    quoted = facts.refresh(listed, crawl(spark, place))
    assert "regexp_extract" in _plan(quoted) and "regexp_extract" not in _plan(rollups.fact_totals(quoted))
    assert rollups.record_totals(records).first().ok == rollups.fact_totals(quoted).first().ok == 1


def test_registry_records_round_trip(spark, tmp_path):
    place = tmp_path / "records.json"
    place.write_text(
        '{"url":"https://a.org","title":"A","categories":["x"],"cited_in":["b.md","a.md"],"status":"ok","verified":"2025-12-15T10:00:00Z"}\n'
        '{"url":"https://b.org","title":"B","categories":["x"],"cited_in":["a.md"],"status":"pending"}\n'
    )
    held = registry_records(spark, str(place))
    lines = [r.value for r in json_lines(registry.records(held).orderBy("url")).collect()]
    assert lines == [
        '{"url":"https://a.org","title":"A","categories":["x"],"cited_in":["b.md","a.md"],"status":"ok","verified":"2025-12-15T10:00:00.000000+00:00"}',
        '{"url":"https://b.org","title":"B","categories":["x"],"cited_in":["a.md"],"status":"pending"}',
    ]
    assert registry.violations(held).isEmpty()
    for text in ('{"url":"u","title":"A","categories":["x"],"cited_in":["a"],"status":"gone"}', '{"url":'):
        place.write_text(text)
        with pytest.raises(Exception):
            registry_records(spark, str(place)).references.collect()


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame(
        [("u", None, [], [("1", None, "$1")], "a/\"ü\"")],
        "url string, site string, links array<string>, amounts array<struct<value:string,unit:string,raw:string>>, title string",
    )
    (line,) = [r.value for r in json_lines(df).collect()]
    assert line == '{"url":"u","amounts":[{"value":"1","unit":null,"raw":"$1"}],"title":"a/\\"ü\\""}'
    write_json_lines(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [line]
