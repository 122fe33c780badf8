"""A bucket is written by as many tasks as its rows need, and no task has those of two buckets."""

from cuemill.streaming import maintained

SCHEMA = "id long, revision long, value string"


def test_no_task_writes_more_than_its_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "ROWS_A_TASK", 200, raising=False)
    table = maintained.BucketTable(spark, str(tmp_path), "id", "revision", SCHEMA, buckets=4)
    sizes = lambda v: [spark.read.parquet(str(f)).count() for f in (tmp_path / "data" / str(v)).rglob("*.parquet")]
    made = table.patch(spark.range(4000).selectExpr("id", "1L as revision", "'a' as value"), 0)
    assert sum(sizes(0)) == 4000 and max(sizes(0)) < 300 and sum(made["rows"].values()) == 4000
    again = table.patch(spark.range(3990, 5000).selectExpr("id", "2L as revision", "'b' as value"), 1)  # few rows to large buckets
    assert sum(sizes(1)) == 5000 == sum(again["rows"].values()) and max(sizes(1)) < 300
    assert table.read().filter("value = 'b'").count() == 1010
    table.rebuild(spark.range(3000).selectExpr("id", "3L as revision", "'c' as value"), 2, 3)
    assert sum(sizes(2)) == 3000 and max(sizes(2)) < 300
