import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb

from cuemill.llm import filter_audit
from cuemill.llm.queries import ORACLE_SQL, QUERIES

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """docs: (doc_id, text, part)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append((i, part or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs),
        }))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine, shapley = [(i, f) for i, p, f in fails if p == part], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f[x] for _, f in mine) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_running_every_order(spark, make_docs, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rng = random.Random(5)
    kinds = [None, "", "word " * 250, " ".join(f"w{i}" for i in range(220)), "A B C " * 90, "x & y " * 10, " ".join(f"q{i}" for i in range(300)) + " #", "é" * 30 + "\x0b\x85 z", "z" * 300_000]
    docs = [(rng.choice([None, i, i, i // 2]), rng.choice(kinds), rng.choice([None, "", "a", "b", "c"])) for i in range(220)]
    docs += [(900 + i, "hot copy", "hot") for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(150) for _ in range(rng.randint(0, 2))] + [(None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "'x' as part", "2 as id", "'y' as body", "3 as digest", "4 as label", "5 as n")
    marks = spark.createDataFrame(labels, LABELS).selectExpr("*", "'t' as text", "0 as id", "0 as label")
    assert found(filter_audit.audit_filters(frame.repartition(3), marks)) == brute(docs, labels)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(make_docs([]), none).collect() == []
    assert found(filter_audit.audit_filters(make_docs(["a", None, "a"]), none)) == brute([(0, "a", "s"), (1, None, "s"), (2, "a", "s")], [])


def test_table_of_first_failures():
    assert filter_audit.FIRST.shape == (32, 120) and (filter_audit.FIRST[0] == 5).all() and len(set(filter_audit.ORDERS)) == 120
    assert filter_audit.FIRST[0b10100, filter_audit.ORDERS.index("ABECD")] == 2


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    answer = con.execute(ORACLE_SQL["op12_filter_audit"])
    names = [c[0] for c in answer.description]
    got = QUERIES["op12_filter_audit"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(answer.fetchall())
