"""Keys that share a state do not know of each other, over batches."""

import random

from cuemill.streaming import keyed

EVENT = "video long, seq long, at_us long, kind string, signature string"


def test_keys_of_a_group_are_kept_apart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(30), n, n * 1_000_000, rng.choice(("request", "request", "failed", "ready")), rng.choice("ab")) for n in range(600)]
    for n in range(3):
        spark.createDataFrame(rows[n * 200 : n * 200 + 200], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = keyed.started_requests(stream, "video", 20, groups=3)
    assert "__group" in started._jdf.queryExecution().logical().toString()
    keyed.run_live(started.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")), 600)
    want, known = [], {}
    for video, seq, at, kind, signature in rows:
        busy, failed, until = known.get(video, (False, None, 0))
        if kind == "request" and not busy and not (failed == signature and at < until):
            want.append(seq)
            busy = True
        elif kind != "request" and busy:
            busy, failed, until = (False, signature, at + 20_000_000) if kind == "failed" else (False, None, 0)
        known[video] = busy, failed, until
    assert sorted(r["seq"] for r in spark.read.schema(EVENT).parquet(str(tmp_path / "out")).collect()) == want
