import importlib.util

import pytest
from test_op1 import brute as contamination
from test_op3_op8 import reference
from test_op7 import brute as near_copies

from cuemill.llm.pii import find_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            wrong = [i for i in before if i in labels and (i not in after) != bool(labels[i])]
            assert len(wrong) <= 0.15 * len(labels) and after.items() <= before.items()
        elif name == "minhash_near_dedup":
            kept = {i for i, _, c in near_copies(list(before.items()), 5) if i == c}
            assert set(after) == kept
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before.items() if not contamination(t, items)[3]}
        elif name == "pii":
            assert set(after) == set(before)
            assert all((after[i] == t) == (not find_spans(t)) for i, t in before.items())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    ids = reference("word_bpe_49k.json")
    total = sum(len(ids(t)) + 1 for t in before.values())
    assert sum(r["length"] for r in docs.collect()) == total


def test_registered():
    assert importlib.util.find_spec("__spark_entry__")
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {k.split("_")[0] for k in names}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated ids and rows, and columns with the names that stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, found string, component_id long, kept boolean, `__score` int"
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (None, text), (None, text), (2, ""), (3, " \n "), (4, text), (5, text + " x"), (6, "mail a.b@c.org now"), (6, "mail a.b@c.org now"), (7, "other text"), (7, None), (8, "long word " * 40_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, 0.9, "f", 5, False, 1) for i, t in rows], schema)
    for table, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{table}.parquet")
    want = [(1, None), (None, text), (None, text), (2, ""), (3, " \n "), (4, text), (6, "mail a.b@c.org now"), (7, "other text"), (8, "long word " * 40_000)]
    key = lambda r: (r[0] or 0, r[1] or "")
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.written(stage(spark, got, str(tmp_path)), name)
        assert got.columns == docs.columns
        found = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key)
        if name == "toxicity":
            assert found == sorted(rows, key=key)
        elif name == "pii":
            assert [r for r in found if r[0] != 6] == [r for r in sorted(want, key=key) if r[0] != 6] and "a.b@c.org" not in str(found)
        else:
            assert found == sorted(want, key=key)
    assert all(r["score"] == 0.9 and r["kept"] is False and r["__score"] == 1 and r["found"] == "f" for r in got.collect())
    pieces = corpus_pipeline.pack(spark, got, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in want}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
