import hashlib
import random
import re

from cuemill.llm.decontaminate import benchmark_windows, find_contamination, is_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        if item is None or not b:
            continue
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def run(docs, items, **options):
    rows = find_contamination(docs, items, **options).withColumn("bad", is_contaminated()).collect()
    return [(r["doc_id"], (r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["items"], r["bad"])) for r in rows]


def cases():
    rng = random.Random(1)
    vocab = ["a", "b", "ça", "dé", "the", "x1", "Of", "日本"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 12, 13, 14, 30])))) for i in range(12)] + [(3, "a b"), (None, "the the the"), (50, None), (51, "..."), (7, "a b")]
    texts = [None, "", "...", "a", "A, b!", " ".join(rng.choice(vocab) for _ in range(40_000))]
    for _ in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20))) for _ in range(3)]
        texts.append((" -- ".join([parts[0], rng.choice(items)[1] or "", parts[1], rng.choice(items)[1] or "", parts[2]])).swapcase())
    return texts, items


def test_equals_brute_force(spark, make_docs):
    texts, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    ids = [1, 1, *range(2, len(texts))]  # a repeated id: each row has its own result
    total = benchmark_windows(table).selectExpr("sum(size(words))").first()[0]
    for options in ({}, {"max_words": -(-total // 10)}):  # one block, and ten
        got = run(make_docs(texts, ids), table, **options)
        assert sorted(got) == sorted((i, brute(t, items)) for i, t in zip(ids, texts, strict=True))


def test_empty_tables_and_clashing_columns(spark, make_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert run(make_docs([]), items) == []
    assert run(make_docs(["one two"]), items.limit(0)) == [(0, (2, 0, [], False))]
    clash = make_docs(["one two three"]).selectExpr("*", "1 as contamination", "2 as n_words")
    clash = clash.selectExpr("*", "3 as row", "4 as __row2")
    for most in (2_000_000, 1):
        found = find_contamination(clash, items, max_words=most)
        out = found.first()
        assert out["n_words"] == 2 and out["row"] == 3 and out["contamination"]["n_hit"] == 2
        assert found.columns == [c for c in clash.columns if c != "contamination"] + ["contamination"]
        assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == (most > 1)  # no chain of indexes in one task


def test_query_digest(spark, sf):
    from cuemill.llm.queries import QUERIES

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_decontaminate"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, ids, bad = brute(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), bad)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
