import json

import pandas as pd
from pyspark.sql import functions as F

from cuemill.sources import files
from cuemill.streaming import feeds


def test_changes_since(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (9000, "c")], "revision long, id string")
    get = lambda *a: tuple(feeds.changes_since(table, *a).first())
    assert get(2, 10_000) == (9000, False, ["a", "c"])
    assert get(9000) == (9000, False, [])
    assert get(2, 100) == (9000, True, [])


def test_late_results_go(spark):
    results = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "key string, generation int, value string")
    now = spark.createDataFrame([("a", 2)], "key string, generation int")
    assert [r["value"] for r in feeds.current_only(results, now, "key").collect()] == ["new"]


def stream(spark, path, rows, n):
    path.mkdir(exist_ok=True)
    pd.DataFrame(rows).to_parquet(path / f"{n}.parquet", coerce_timestamps="us")


def test_throttle(spark, tmp_path):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    stream(spark, tmp_path / "in", [{"id": "v", "progress": p, "at": at(s), "revision": int(s * 10)} for p, s in [(1, 0), (1, 0.1), (1, 0.3), (2, 0.35), (2, 0.4)]], 1)
    source = spark.readStream.schema("id string, progress long, at timestamp, revision long").parquet(str(tmp_path / "in"))
    q = feeds.throttled(source, "id", "progress", "at").writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["progress"] for r in spark.table("throttled").orderBy("at").collect()] == [1, 1, 2]


def test_subtitles_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("a", 0.5, 2.0, "one\ntwo"), ("a", 3661.25, 3662.5, "three")], "video string, start double, end double, text string")
    text = files.to_srt(cues, "video").first()["value"]
    assert text.startswith("1\n00:00:00,500 --> 00:00:02,000\none\ntwo\n\n2\n01:01:01,250")
    (tmp_path / "a.srt").write_text(text)
    assert [(r["start"], r["end"], r["text"]) for r in files.read_srt(spark, str(tmp_path)).orderBy("start").collect()] == [(0.5, 2.0, "one two"), (3661.25, 3662.5, "three")]
    assert files.to_ass_events(cues).orderBy("start").first()["value"] == "Dialogue: 0,0:00:00.50,0:00:02.00,Default,,0,0,0,,one\\Ntwo"


def test_json_logs_and_listings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"start": 0, "end": 1.5, "text": "hi", "language": "en"}, {"start": 2, "end": 3, "text": None}]))
    rows = files.read_segments(spark, str(tmp_path / "s.json")).orderBy("seq").collect()
    assert [(r["seq"], r["end"], r["text"]) for r in rows] == [(0, 1.5, "hi"), (1, 3.0, None)]
    assert files.read_json_arrays(spark, str(tmp_path / "s.json")).count() == 2
    assert files.read_json_texts(spark, str(tmp_path / "s.json")).first()["raw"].startswith("[")
    (tmp_path / "x.log").write_text("one\r\ntoken: abc\n")
    lines = files.read_log(spark, str(tmp_path / "x.log"))
    assert [r["value"] for r in lines.orderBy("seq").collect()] == ["one", "token: abc"]
    files.write_redacted(lines, str(tmp_path / "out"))
    assert "token: <redacted>" in [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    for name in ("B.mp4", "a.MP4", "c.txt"):
        (tmp_path / "media").mkdir(exist_ok=True)
        (tmp_path / "media" / name).write_bytes(b"x")
    usable, rejected = files.media_files(files.list_files(spark, str(tmp_path / "media")))
    assert [r["name"] for r in usable.collect()] == ["a.MP4", "B.mp4"] and rejected.count() == 1
    kept = spark.range(3)
    assert files.unchanged(kept, spark.range(3)) and not files.unchanged(kept, kept.select(F.col("id") + 1))
