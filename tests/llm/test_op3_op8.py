import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from cuemill.llm import packing, repair
from cuemill.llm.queries import QUERIES
from cuemill.llm.tokens import encoder

TRICKY = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it 's  don't", "é è x", "x᠎ y", "tab\t c", "<|endoftext|> hi<|endoftext|>", "ÀÉ straße ΟΔΟΣ ος", "1 234 .. ,b", "日本 語　x", "\n\n", "a\r\nb c\x1c d", "é ́x"]


def reference(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_memo_encoding_equals_whole_texts(sf, spark):
    texts = TRICKY + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice([" ", "a", "'s", "\n", "é", "1", ".", "B", "\t", " "]) for _ in range(30)) for _ in range(800)]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        want, got = reference(name), encoder(public_tokenizers.path(name), keeps).encode(pa.array([None, *texts]))
        assert got[0] == b""
        for t, ids in zip(texts, got[1:], strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want(t), (name, t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(pieces, docs, length=2048):
    want = reference("word_bpe_49k.json")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for d, rows in by_doc.items():
        ids, at = want(docs[d]) + [1], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length and (at & (at - 1)) == 0  # full, or a power of two: no padding


def test_packing_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing(QUERIES["op3_packing"](spark, sf).collect(), docs)


def test_packing_cases(spark, make_docs):
    from pyspark.sql import functions as F

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = make_docs([None, "", "a b", "word " * 9000, "a b"], [1, 2, 3, 4, 5]).selectExpr("*", "7 as length", "8 as ids")
    rows = packing.pack_along_curve(docs, path).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, {1: None, 2: "", 3: "a b", 4: "word " * 9000, 5: "a b"})
    repeated = packing.pack_along_curve(make_docs(["x y", "x y"], [9, 9]), path).collect()
    assert sum(r["length"] for r in repeated) == 6 and {r["sequence_id"] for r in repeated} == {0, 1}
    assert packing.pack_along_curve(make_docs([]), path).collect() == []


def test_hilbert_index_is_a_curve():
    pts = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_index(pts, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(pts[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_grammar_round_trip():
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 50, 5000):
        docs = [rng.integers(0, 6, rng.integers(1, size + 2)).astype(np.uint32) for _ in range(20)] + [np.zeros(size + 1, np.uint32)]
        payload = repair.to_payload(docs)
        reader = repair.ShardReader(payload)
        assert [d.tolist() for d in reader.documents()] == [d.tolist() for d in docs]
        for i, d in enumerate(docs):
            assert reader.document(i).tolist() == d.tolist()
            for at in {0, len(d) // 2, len(d) - 1}:
                assert reader.token(i, at) == d[at]
    assert len(repair.to_payload([np.tile(np.arange(8, dtype=np.uint32), 4000)])) < 32_000


def pairs_left(symbols, per_doc):
    """Greatest number of occurrences of a pair inside documents, those that overlap themselves counted once."""
    seen, at = Counter(), 0
    for n in per_doc.tolist():
        doc, i, last = symbols[at : at + n].tolist(), 0, {}
        for i in range(n - 1):
            pair = doc[i], doc[i + 1]
            if last.get(pair) != i - 1:
                seen[pair] += 1
                last[pair] = i
        at += n
    return max(seen.values(), default=0)


def test_grammar_is_complete_and_smaller_than_plain_ids(spark, sf):
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"), True).encode
    texts = pa.array([r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])
    docs = [np.frombuffer(e + b"\2\0\0\0", "<u4") for e in encode(texts)]
    rng = np.random.default_rng(5)
    for sample in (docs, [rng.integers(0, 3, 3000).astype(np.uint32) for _ in range(4)], [np.ones(50, np.uint32)]):
        *_, symbols, per_doc = repair.compress(sample)
        assert pairs_left(symbols, per_doc) < repair.LEAST
    assert len(repair.to_payload(docs)) < 0.75 * 2 * sum(map(len, docs))


def test_bits_round_trip():
    rng = np.random.default_rng(6)
    for width in (1, 7, 13, 17, 32):
        values = rng.integers(0, 1 << width, 1001).astype(np.uint32)
        packed = repair.pack_bits(values, width)
        assert len(packed) == -(-1001 * width // 8) and (repair.unpack_bits(np.frombuffer(packed + b"xx", np.uint8), 1001, width) == values).all()


def test_token_file_query(spark, sf):
    want = reference("byte_bpe_50k.json")
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op8_token_files"](spark, sf).collect()}
    at = 0
    for d, text in docs:
        ids = want(text) + [2]
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(docs)


def test_token_file_cases(spark, make_docs, tmp_path):
    docs = make_docs([None, "", "b", "b", "long text " * 30_000], [3, 1, 2, 2, None]).selectExpr("*", "1 as part", "2 as start")
    repair.write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(repair.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3]
    assert [r["n_tokens"] for r in rows][1:] == [1, 2, 2, 1]
    repair.write_token_files(make_docs([]), str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"))
    assert repair.read_token_files(spark, str(tmp_path / "e")).collect() == []
