import pytest

from cuemill.streaming import fanout, keyed, maintained

SCHEMA = "id long, revision long, value string"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination(120)


def test_failing_sink_gets_its_batches_after_restart(spark, tmp_path):
    told, works = [], [False]
    path = str(tmp_path)

    def flaky(rows, number):
        if not works[0]:
            raise OSError("host is down\nmore")
        fanout.table_sink(f"{path}/b")(rows, number)

    sinks = {"a": fanout.table_sink(f"{path}/a"), "b": flaky, "c": fanout.table_sink(f"{path}/c", lambda rows: rows.filter("id > 1"))}
    for n in range(2):
        stream = feed(spark, tmp_path / "in", [(n * 2, 0, "x"), (n * 2 + 1, 0, "y")], SCHEMA)
        run(fanout.fan_out(stream, sinks, f"{path}/bus", f"{path}/checkpoint", lambda *what: told.append(what)))
    ids = lambda name: sorted(r["id"] for r in spark.read.schema(SCHEMA).parquet(f"{path}/{name}").collect())
    assert ids("a") == [0, 1, 2, 3] and ids("c") == [2, 3] and not (tmp_path / "b").exists()
    assert [(s, n) for s, n, _ in told] == [("b", 0), ("b", 1)] and told[0][2] == "host is down"
    works[0] = True
    stream = feed(spark, tmp_path / "in", [(4, 0, "z")], SCHEMA)
    run(fanout.fan_out(stream, sinks, f"{path}/bus", f"{path}/checkpoint"))
    assert ids("b") == ids("a") == [0, 1, 2, 3, 4]
    assert not list((tmp_path / "bus" / "spool").glob("[0-9]*"))
    assert fanout.deliver(spark, f"{path}/bus", sinks) == {}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = maintained.BucketTable(spark, str(tmp_path), "id", "revision", SCHEMA, buckets=8)
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "data" / str(v)).rglob("*.parquet"))
    first = table.patch(spark.range(4000).selectExpr("id", "1L as revision", "uuid() as value"), 0)
    whole = size(0)
    one = table.patch(spark.createDataFrame([(5, 2, "new"), (5, 1, "old")], SCHEMA), 1)
    assert first["touched"] == 8 and one["touched"] == 1 and size(1) < whole / 6
    late = table.patch(spark.createDataFrame([(5, 1, "late")], SCHEMA), 2)
    rows = table.read()
    assert rows.count() == 4000 and rows.filter("id = 5").first()["value"] == "new" and late["version"] == 2
    again = table.patch(spark.createDataFrame([(5, 1, "late")], SCHEMA), 2)  # a batch that is run twice
    assert again["folders"] == late["folders"] and table.read().count() == 4000
    table.patch(spark.createDataFrame([(5, None, None, True), (9, 3, "x", False)], SCHEMA + ", gone boolean"), 3, gone="gone")
    assert table.read().count() == 3999 and table.versions() == [2, 3]
    assert table.read(2).filter("id = 5").count() == 1  # the version before stays readable


def test_poll_without_changes_writes_nothing(spark, tmp_path):
    table = maintained.BucketTable(spark, str(tmp_path), "id", "revision", SCHEMA, buckets=4)
    log = spark.createDataFrame([(1, 7), (2, 8)], "revision long, id long")
    source = spark.createDataFrame([(7, 1, "a"), (8, 2, "b")], SCHEMA)
    assert table.poll(log, source)[0] == "rebuilt"
    before = table.versions()
    assert table.poll(log, source)[0] == "unchanged" and table.versions() == before
    log = log.unionAll(spark.createDataFrame([(3, 8), (4, 9)], "revision long, id long"))
    action, made = table.poll(log, spark.createDataFrame([(7, 1, "a"), (9, 4, "c")], SCHEMA))
    assert action == "patched" and made["revision"] == 4 and made["touched"] <= 2
    assert sorted(tuple(r) for r in table.read().collect()) == [(7, 1, "a"), (9, 4, "c")]
    assert table.poll(log.filter("revision < 0"), source)[0] == "unchanged"


EVENT = "video long, seq long, at_us long, kind string, signature string"


def test_failure_memory(spark, tmp_path):
    second = 1_000_000
    batches = [
        [(1, 0, 0, "request", "a"), (1, 1, 1, "request", "a"), (2, 2, 0, "failed", "x"), (2, 3, 1, "request", "x")],
        [(1, 4, 2 * second, "failed", "a"), (1, 5, 3 * second, "request", "a"), (2, 6, second, "ready", "x"), (2, 7, second, "request", "x")],
        [(1, 8, 4 * second, "request", "b"), (2, 9, 2 * second, "failed", "x"), (2, 10, 13 * second, "request", "x")],
    ]
    for rows in batches:
        stream = feed(spark, tmp_path / "in", rows, EVENT)
    started = keyed.started_requests(stream, "video", 10)
    keyed.run_live(started.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")), 11)
    assert sorted(r["seq"] for r in spark.read.schema(EVENT).parquet(str(tmp_path / "out")).collect()) == [0, 3, 7, 8, 10]


def test_stream_that_never_gets_its_rows_is_an_error(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [(1, 1, "a")], SCHEMA)
    idle = keyed.idle_timeouts(stream, "id", "revision", 60)
    with pytest.raises(TimeoutError):
        keyed.run_live(idle.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")), 5, seconds=8)


def test_totals_take_back_old_values(spark, tmp_path):
    schema = "id long, revision long, team string, points long"
    table = maintained.BucketTable(spark, str(tmp_path / "t"), "id", "revision", schema, buckets=4)
    batches = [[(1, 1, "a", 5), (2, 1, "a", None), (3, 1, "b", 7)], [(1, 2, "b", 6), (3, 1, "z", 99), (2, 0, "a", 50)], [(3, 2, "b", 1), (4, 1, None, 2), (1, 3, "b", 6)]]
    for rows in batches:
        stream = feed(spark, tmp_path / "in", rows, schema)
        run(maintained.maintain_totals(stream, table, "team", ["points"], str(tmp_path / "out"), str(tmp_path / "c")))
    got = maintained.totals(spark.read.parquet(str(tmp_path / "out")), "team")
    assert {r["team"]: (r["rows"], r["points"]) for r in got.collect()} == {"a": (1, 0), "b": (2, 7), None: (1, 2)}
