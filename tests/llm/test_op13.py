import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from cuemill.llm import shards
from cuemill.llm.queries import QUERIES


def least_capacity(sizes, count):
    """By dynamic programming over all contiguous partitions of ``sizes`` into at most ``count`` parts."""
    ends = [0, *accumulate(sizes)]
    best = ends[:]
    for _ in range(count - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


def check(rows, docs, count):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < count
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = defaultdict(set)
    for r in rows:
        texts[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    return size


def ordered_groups(spark, docs):
    """Sizes of the groups in the order of their keys."""
    frame = spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("xxhash64(t) key", "octet_length(t) + 8 size")
    found = [r["size"] for r in frame.groupBy("key").agg({"size": "sum"}).withColumnRenamed("sum(size)", "size").orderBy("key").collect()]
    return found


def minimax(groups, count):
    """Least capacity for the groups that do not fill a shard alone, and the sizes of those that do."""
    groups, alone = list(groups), []
    while groups and max(groups) > sum(groups) / (count - len(alone)):
        alone.append(max(groups))
        groups.remove(max(groups))
    return least_capacity(groups, count - len(alone)) if groups else 0, alone


def greatest(size, alone):
    """Size of the largest shard but for those of ``alone``."""
    left = Counter(size.values())
    left.subtract(alone)
    assert min(left.values(), default=0) >= 0
    return max(left.elements(), default=0)


@pytest.mark.parametrize(("n", "seed", "bits"), [(150, 2, 1), (300, 3, 14), (60, 4, 2)])
def test_capacity_equals_dynamic_programming(spark, make_docs, monkeypatch, n, seed, bits):
    monkeypatch.setattr(shards, "FIRST_BITS", bits)
    monkeypatch.setattr(shards, "NEXT_BITS", 2)
    monkeypatch.setattr(shards, "AT_ONCE", 3)
    rng = random.Random(seed)
    texts = [rng.choice(["copy " * 40, "b" * rng.randint(0, 500), f"x{rng.random()}" * rng.randint(1, 60), None, ""]) for _ in range(n)]
    docs = list(enumerate(texts))
    for count in (24, 3):
        size = check(shards.shard_documents(make_docs(texts), count).collect(), docs, count)
        groups = ordered_groups(spark, docs)
        want, alone = minimax(groups, count)
        assert greatest(size, alone) == want


def test_hot_group_fills_one_shard_and_others_stay_even(spark, make_docs):
    texts = ["hot text " * 30] * 400 + [f"text {i} " * 20 for i in range(800)]
    size = check(shards.shard_documents(make_docs(texts)).collect(), list(enumerate(texts)), 24)
    rest = sorted(size.values())[:-1]
    assert len(size) == 24 and size[0] == 400 * (270 + 8)
    assert max(rest) - min(rest) <= 400


def test_edge_cases(spark, make_docs):
    assert shards.shard_documents(make_docs([])).collect() == []
    docs = [(1, "a"), (1, "a"), (2, None), (3, ""), (4, "é" * 10), (5, "z" * 2_000_000), (5, "other")]
    frame = make_docs([t for _, t in docs], [i for i, _ in docs]).selectExpr("doc_id", "text", "'x' as size", "'y' as shard", "1 as slot", "2 as key", "3 as row", "null as chunk")
    size = check(shards.shard_documents(frame).collect(), docs, 24)
    assert len(size) == 5 and max(size.values()) == 2_000_008
    lone = spark.createDataFrame([(None, "q"), (None, "q")], "doc_id long, text string")
    assert sorted(r["slot"] for r in shards.shard_documents(lone).collect()) == [0, 1]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op13_minimax_shards"](spark, sf)
    size = check(found.collect(), docs, 24)
    want, alone = minimax(ordered_groups(spark, docs), 24)
    assert greatest(size, alone) == want
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "ExistingRDD"))
