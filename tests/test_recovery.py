import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import recovery
from cuemill.operators.dedup import first_accepted
from cuemill.streaming.maintained import BucketTable


def greedy(rows):
    """rows: (position, group, id, url); the positions kept."""
    ids, urls, kept = set(), set(), []
    for position, g, i, u in sorted(rows, key=lambda r: r[0]):
        if (g, i) not in ids and (g, u) not in urls:
            ids.add((g, i))
            urls.add((g, u))
            kept.append(position)
    return kept


def test_dedup_equals_a_fold_in_order(spark):
    rng = random.Random(1)
    rows = [(p, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(14)]), rng.choice([None, *range(14)])) for p in range(160)]
    chain = [(1000 + p, 9, (p + 1) // 2, p // 2) for p in range(12)]  # each row waits for the one before
    hot = [(2000 + p, 5, 7, p) for p in range(60)]  # one id
    for part in (rows, chain + hot, []):
        frame = spark.createDataFrame(part, "position long, g long, id long, url long")
        found = first_accepted(frame, [["g", "id"], ["g", "url"]], ["position"])
        assert sorted(r["position"] for r in found.collect()) == greedy(part)
    twice = spark.createDataFrame([(1, 1, 1, 1)] * 3, "position long, g long, id long, url long")
    assert first_accepted(twice, [["g", "id"], ["g", "url"]], ["position"]).count() == 1
    assert "Python" not in first_accepted(frame, [["g", "id"]], ["position"])._jdf.queryExecution().toString()


def merge(records, manifests):
    """By one pass in order, as lists of (key, root)."""
    now = dict(records)
    for key, root, _ in sorted(manifests, key=lambda m: m[2]):
        if not any(r == root and k != key for k, r in now.items()):
            now[key] = root
    return sorted(now.items())


@pytest.mark.parametrize("seed", range(3))
def test_manifests_merge_in_order(spark, seed):
    rng = random.Random(seed)
    records = [(k, rng.randrange(9)) for k in range(9)]  # roots may be shared
    roots = rng.sample(range(14), 10)
    manifests = [(k, roots[i], o) for i, (k, o) in enumerate(zip(rng.sample(range(12), 10), rng.sample(range(10), 10), strict=True))]
    a = spark.createDataFrame([("c", k, r, "b") for k, r in records], "catalogue string, key long, root long, name string")
    m = spark.createDataFrame([("c", k, r, "m", o) for k, r, o in manifests], "catalogue string, key long, root long, name string, seen long")
    got = recovery.merge_manifests(a, m, "key", "root", "seen").collect()
    assert sorted((r["key"], r["root"]) for r in got) == merge(records, manifests)


def test_damaged_files_fall_back(spark, tmp_path):
    for name, text in {"a": '{"key": 1, "root": "x"}\n\n', "b": '{"key": 2, "ro', "c": "[]\n", "d": '{"key": 3}'}.items():
        (tmp_path / "primary").mkdir(exist_ok=True)
        (tmp_path / "primary" / f"{name}.json").write_text(text)
    (tmp_path / "backup").mkdir()
    (tmp_path / "backup" / "b.json").write_text('{"key": 2, "root": "old"}\n{"key": 5, "root": "y"}')
    (tmp_path / "backup" / "d.json").write_text("nothing")
    read = lambda n: recovery.read_records(spark, str(tmp_path / n), "key long, root string", ["key", "root"])
    manifests = spark.createDataFrame([("b", 2, "new", 1), ("b", 7, "y", 2), ("d", 4, "z", 1), ("d", 4, "w", 2), ("a", 1, "ignored", 1)], "catalogue string, key long, root string, seen long")
    rows, states = recovery.recover_catalogues(read("primary"), read("backup"), manifests, "key", "root", "seen")
    assert {r["catalogue"]: r["source"] for r in states.collect()} == {"a": "primary", "b": "backup", "c": "lost", "d": "manifests"}
    assert sorted((r["catalogue"], r["key"], r["root"]) for r in rows.collect()) == [("a", 1, "x"), ("b", 2, "new"), ("b", 5, "y"), ("d", 4, "z")]
    assert sorted((r["catalogue"], r["reason"]) for r in read("primary")[1].collect()) == [("b", "corrupt"), ("c", "corrupt"), ("d", "incomplete")]


def test_replacement_is_whole_or_not_at_all(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "id", "revision", "id long, revision long, status string, source string", buckets=4)
    table.patch(spark.createDataFrame([(1, 1, "done", "a"), (2, 1, "processing", "b"), (3, 1, "failed", "c")], "id long, revision long, status string, source string"), 0)
    new = spark.createDataFrame([(1, 2, "A"), (2, 2, "B"), (9, 2, "C")], "id long, revision long, source string")

    def refuse(rows):
        raise ValueError("bad rows\nin detail")

    state = lambda: sorted((r["id"], r["status"], r["source"]) for r in table.read().collect())
    old = state()
    for check, finish in ((refuse, lambda r: None), (lambda r: None, refuse)):
        said, refused = recovery.replace_inputs(table, new, "id", {"status": "pending"}, check, finish)
        assert said == "rolled back: bad rows" and state() == old and sorted(r["id"] for r in refused.collect()) == [2, 9]
    assert recovery.replace_inputs(table, new, "id", {"status": "pending"}, lambda r: None)[0] == "replaced"
    assert state() == [(1, "pending", "A"), (2, "processing", "b"), (3, "failed", "c")]


def test_ownership_before_deletion(spark):
    projects = spark.createDataFrame([(1, "/d/a", "/d"), (2, "/d/b", "/d"), (3, "/D/b/", "/d"), (4, "/d/c", "/d"), (5, "/d/c/x", "/d"), (6, "/e/q", "/d"), (7, "/d/../e", "/d"), (8, "/d/cc", "/d")], "id long, root string, home string")
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 6, 7, 8, 99)], "id long")
    found = {r["id"]: r["reason"] for r in recovery.deletable(projects, wanted, "id", "root", "home").collect()}
    assert found == {1: None, 2: "shared", 4: "shared", 5: None, 6: "outside", 7: "outside", 8: None, 99: "unknown"}
    assert recovery.deletable(projects, wanted.filter(F.lit(False)), "id", "root", "home").collect() == []
