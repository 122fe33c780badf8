import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cuemill.llm import alignment
from cuemill.llm.queries import QUERIES
from cuemill.llm.tokens import byte_letters, piece_encoder

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", " ", "a", " a", "a ", "a  b", "   ", "\n", "a\n b", "x▁y", "▁", "<|endoftext|> hi<|endoftext|>", "<s> </s><unk> <0x0A>", "é ́x ﬁ", "日本 語　x", "tab\tc", "\x00z", "𝒳𝒴 z", "it's  don't", "a b", "1 234 .. ,b", "ÀÉ straße"]


@pytest.fixture(scope="module")
def brute():
    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(byte_letters())}

    def sides(text):
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
        spelled = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == spelled == b"".join(x for _, x in b) else ([], [])

    def ends(side):
        out, at = {}, 0
        for k, (_, piece) in enumerate(side):
            at += len(piece)
            out[at] = k
        return out

    def run(docs):
        links, rows = Counter(), []
        for i, text in docs:
            a, b = sides(text)
            ea, eb = ends(a), ends(b)
            cuts = sorted(ea.keys() & eb.keys())
            mine = [(a[ea[c]][0], b[eb[c]][0]) for c in cuts]
            groups, la, lb = [], 0, 0
            for c in cuts:
                groups.append(",".join(str(x) for x, _ in a[la : ea[c] + 1]) + "|" + ",".join(str(x) for x, _ in b[lb : eb[c] + 1]))
                la, lb = ea[c] + 1, eb[c] + 1
            links.update(mine)
            rows.append((i, len(a), len(b), len(cuts), mine, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        best = Counter()
        for (_, y), n in links.items():
            best[y] = max(best[y], n)
        return Counter((i, a, b, g, len(mine), sum(links[p] == best[p[1]] for p in mine), sum(links[p] for p in mine), h) for i, a, b, g, mine, h in rows)

    run.sides = sides
    return run


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pieces_apart_equal_whole_texts(spark, sf):
    model, mine = sentencepiece.SentencePieceProcessor(model_file=B), piece_encoder(B)
    assert mine.apart
    rng = random.Random(4)
    texts = TRICKY + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    texts += ["".join(rng.choice([" ", " ", "a", "'s", "\n", "é", "1", ".", "B", "\t", "th", "日", "𝒳"]) for _ in range(40)) for _ in range(800)]
    texts = [t for t in texts if "▁" not in t]
    for t, ids in zip(texts, mine.encode(pa.array([" " + t for t in texts])), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t) or not t, t


def test_tricky_texts_and_rare_pairs(spark, brute, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 300)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 40)
    rng = random.Random(9)
    texts = TRICKY + [None, "hot copy of a text"] * 20 + [" ".join(rng.choice(["the", "internationalisation", "Zürich", "x9", "don't"]) for _ in range(30)) for _ in range(40)] + ["long " * 20_000, "q" * 3000]
    docs = [(rng.choice([None, i, i, i // 2]), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as pairs", "2 as n", "3 as n_a", "4 as times", "5 as pair", "6 as rest").repartition(3)
    want = brute(docs)
    for frequent in (alignment.FREQUENT, 25, 0):
        assert Counter(map(tuple, alignment.align_corpus(frame, A, B, frequent=frequent).select(*COLUMNS).collect())) == want


def test_overlaps(spark, make_docs, brute):
    texts = [*TRICKY, None]
    rows = alignment.token_overlaps(make_docs(texts), A, B).collect()
    for i, text in enumerate(texts):
        a, b = brute.sides(text)
        owner = [[k for k, (_, piece) in enumerate(side) for _ in piece] for side in (a, b)]
        want, byte = [], 0
        for pair in sorted(set(zip(*owner, strict=True))):
            n = sum(p == pair for p in zip(*owner, strict=True))
            done = all(byte + n == sum(len(p) for _, p in side[: k + 1]) for side, k in zip((a, b), pair, strict=True))
            want.append((pair[0], a[pair[0]][0], pair[1], b[pair[1]][0], byte, byte + n, done))
            byte += n
        assert sorted(tuple(r)[1:] for r in rows if r["doc_id"] == i) == want


def test_empty_table(spark, make_docs):
    assert alignment.align_corpus(make_docs([]), A, B).collect() == []
    assert [r["n_a"] for r in alignment.align_corpus(make_docs([None, ""]), A, B).collect()] == [0, 0]


def test_query(spark, sf, brute):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_byte_owners"](spark, sf).select(*COLUMNS).collect())) == brute(docs)
