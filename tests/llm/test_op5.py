import zlib

import numpy as np

from cuemill.llm import toxicity
from cuemill.llm.queries import QUERIES


def plain_kernel(s, t):
    """Gap-weighted runs of three letters that span at most SPAN letters, by their definition."""

    def bag(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(w))):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out

    a, b = bag(s), bag(t)
    norm = lambda x: sum(v * v for v in x.values()) ** 0.5
    return sum(v * b.get(k, 0) for k, v in a.items()) / (norm(a) * norm(b) or 1)


def test_kernel_is_its_definition():
    words = ["trash", "t", "", "aaaa", "traash", "être", "abcabc", "日本語x"]
    assert np.allclose(toxicity.kernel(words, words), [[plain_kernel(s, t) for t in words] for s in words])


def test_words_and_pieces():
    assert "idiot" in toxicity.words_of("you i.d.i.o.t !")
    assert toxicity._pieces("1d10t,") == ["idiot"]
    assert "".join(dict.fromkeys("".join(toxicity._pieces("abcdefghijklmnopqrstuvwxyz")))) == "abcdefghijklmnopqrstuvwxyz"
    assert toxicity.words_of(None) == set()


def corpus(make_docs, spark):
    rng = np.random.default_rng(1)
    syllables = ["ban", "dor", "lem", "ti", "ras", "on", "vel", "ku", "shi", "pa"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(300)]
    toxic = [int(i % 4 == 0) for i in range(300)]
    texts = [t + " you " + ["zgrumpf", "qwibble"][i // 4 % 2] if y else t for i, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_learns_and_tolerates_gaps(spark, make_docs):
    texts, labels = corpus(make_docs, spark)
    machine = toxicity.train_machine(make_docs(texts), labels)
    probe = ["a zgrumpf here", "a zgr-umpf here", "z g r u m p f", "zgruxmpf", "qwibbles", "ban dor lem", "", None, "ban dor " * 50_000, "ban dor lem"]
    docs = make_docs(probe).selectExpr("*", "1 as toxicity", "2 as margin")
    got = [r["toxicity"] for r in toxicity.score_toxicity(docs, machine).collect()]
    assert all(s >= 0.5 for s in got[:5]), got
    assert all(0 <= s < 0.5 for s in got[5:]), got
    assert got[5] == got[9] and got[6] == got[7]
    assert toxicity.score_toxicity(make_docs([]), machine).collect() == []


def test_no_labels(spark, make_docs):
    docs = make_docs(["a b c", None])
    for rows in ([], [(0, 1, 1)], [(0, 1, None), (None, 1, 1)]):
        machine = toxicity.train_machine(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert all(r["toxicity"] < 0.5 for r in toxicity.score_toxicity(docs, machine).collect())


def plain_score(machine, text):
    """The score of a text by definition: its best word's weighted subsequences, one by one."""
    weights = dict(zip(machine.ids.tolist(), machine.weights.tolist(), strict=True))

    def margin(piece):
        w, bag = f"\x02{piece[: toxicity.PIECE]}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(w))):
                    a, b, c = (min(ord(w[x]), 0xFFFFF) for x in (i, j, k))
                    key = a << 40 | b << 20 | c
                    bag[key] = bag.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        norm = sum(v * v for v in bag.values()) ** 0.5 or 1
        return machine.bias + sum(v / norm * weights.get(k, 0.0) for k, v in bag.items())

    best = max(margin(p) for word in (toxicity.words_of(text) or {""}) for p in toxicity._pieces(word))
    return 1 / (1 + np.exp(-np.clip(machine.slope * best + machine.shift, -30, 30)))


def test_query_equals_brute_force(spark, sf):
    from pyspark.sql import functions as F

    from cuemill.llm.queries import is_held_out

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.train_machine(docs.select("doc_id", "text"), labels, ~is_held_out(F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_score(machine, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert np.mean([a == b for a, b in held]) >= 0.8
