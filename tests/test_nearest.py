import random

from cuemill.operators import timed_text as T


def brute(segments, sources):
    out = {}
    for k, seq, a, b in segments:
        mine = [(max(0.0, min(b, d) - max(a, c)), abs((a + b) / 2 - (c + d) / 2), q) for key, q, c, d in sources if key == k]
        if mine:
            most = max(m[0] for m in mine)
            out[k, seq] = min((m[1:] for m in mine if m[0] == most))[1], round(most, 3)
    return out


def test_best_overlap_or_nearest(spark):
    rng = random.Random(2)
    at = lambda: rng.randrange(0, 20_000) / 8
    make = lambda n, keys: [(rng.choice(keys), i, s, s + rng.randrange(1, 40) / 8) for i in range(n) for s in (at(),)]
    segments, sources = make(300, "abc"), make(60, "ab") + [("a", 900, 100.0, 101.0), ("a", 901, 100.0, 101.0)]
    schema = "key string, seq long, start double, end double"
    found = T.best_overlap(spark.createDataFrame(segments, schema), spark.createDataFrame(sources, schema), "key", 50.0).collect()
    assert {(r["key"], r["seq"]): (r["source_seq"], r["overlap"]) for r in found} == brute(segments, sources)
    assert T.best_overlap(spark.createDataFrame(segments, schema), spark.createDataFrame([], schema), "key").collect() == []
