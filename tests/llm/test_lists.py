"""Lists of ids against wide rows, and bounded samples."""

from linkloom.llm import lists, sampling


def test_rows_within_and_without(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, f"t{i}", i) for i in range(200)], "doc_id bigint, text string, n int")
    ids = spark.createDataFrame([(i,) for i in (3, 3, 4, 999, None)], "doc_id bigint")
    assert sorted(r.doc_id for r in lists.within(rows, ids).collect()) == [3, 4]
    left = lists.without(rows, ids)
    assert left.columns == rows.columns and left.count() == 198
    assert left.where("doc_id IS NULL").count() == 20
    values = spark.createDataFrame([(3, "a"), (5, "b")], "doc_id bigint, more string")
    joined = lists.with_values(rows, values)
    assert joined.count() == 200
    assert {(r.doc_id, r.more) for r in joined.where("more IS NOT NULL").collect()} == {(3, "a"), (5, "b")}
    assert lists.without(rows.limit(0), ids).count() == 0 and lists.without(rows, ids.limit(0)).count() == 200


def test_samples_are_bounded(spark):
    rows = spark.range(2000).selectExpr("id % 2 AS a", "'same' AS b")
    assert len(sampling.some_rows(rows, 10, 2000)) <= 20
    assert len(sampling.some_rows(spark.range(30).toDF("a"), 50, 30)) == 30
    assert sampling.some_rows(spark.range(0).toDF("a"), 5, 0) == []
