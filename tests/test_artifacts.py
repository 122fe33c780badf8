import json

from pyspark.sql import functions as F

from cuemill.operators import artifacts as A


def test_ascii_lines_restore_the_text(spark):
    texts = ["", "plain \"quoted\" \\ back", "tiếng Việt", "日本 𝒳😀 end", "é", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", A.ascii_json(F.struct("i", F.col("t").alias("text"))).alias("line")).collect():
        assert r["line"].isascii() and json.loads(r["line"]).get("text") == texts[r["i"]]


def test_stagger(spark):
    texts = ["", "abc", "Zürich 日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.stagger(F.col("t")).alias("s")).collect()
    assert {r["t"]: round(r["s"], 6) for r in rows} == {t: round(sum(t.encode()) % 7 * 0.15, 6) for t in texts}


def test_files(spark):
    jobs = spark.createDataFrame([(1, "/w/1"), (2, "/w/2"), (3, "/w/3")], "k int, workspace string")
    files = spark.createDataFrame([("/w/1/x.mp4", 5), ("/w/1/y.webm", 9), ("/w/1/z.part", 10), ("/w/2/in/deep.mkv", 1)], "path string, modified int")
    named = spark.createDataFrame([(1, 0, None), (1, 1, "/w/1/x.tmp"), (2, 0, "/w/1/x.mp4"), (2, 1, "/w/2/in/deep.mkv")], "k int, position int, path string")
    assert {r["k"]: r["path"] for r in A.downloaded_file(jobs, named, files, "k", "workspace").collect()} == {1: "/w/1/x.mp4", 2: "/w/2/in/deep.mkv", 3: None}
    assert {r["k"]: r["path"] for r in A.downloaded_file(jobs, named.limit(0), files, "k", "workspace").collect()} == {1: "/w/1/y.webm", 2: None, 3: None}
    videos = spark.createDataFrame([(1, {"final": "f", "input": "i"}), (2, {"final": "lost"}), (3, {}), (4, None)], "k int, files map<string,string>")
    there = spark.createDataFrame([("i", 0)], "path string, modified int")
    assert {r["k"]: r["path"] for r in A.resolved_file(videos, there, "k", ["final", "input"], F.lit("/x")).collect()} == {1: "i", 2: "lost", 3: "/x", 4: "/x"}


def test_reports_keep_listed_fields(spark):
    rows = spark.createDataFrame([({"version": "1", "user": "me"},), (None,)], "m map<string,string>")
    assert [r["m"] for r in rows.select(A.build_information(F.col("m")).alias("m")).collect()] == [{"version": "1"}, {}]
