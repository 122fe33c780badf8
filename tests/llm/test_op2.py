import hashlib
import random
import re

from cuemill.llm.pii import find_pii, find_spans, redact_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [x * 2 if x < 5 else x * 2 - 9 for x in d[1::2]]) % 10 == 0


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def brute(t):
    t = t or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def base(t):
    return [s for s in find_spans(t) if s[0] in ("email", "ip", "card", "phone")]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = ["@", "a", "b.c", ".", "-", "1", "25", "255", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "+", " ", "x@y.z", "é", "10.0.0.1", "(", ")", "%", "://u:p@", "9" * 30, "日", "account 12345678", "\n"]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert base(t) == brute(t), repr(t)


def test_added_spans():
    assert ("login", 8, 14) in find_spans("https://me:pwd@host.example/x")
    assert ("account", 5, 32) in find_spans("IBAN GB82 WEST 1234 5698 7654 32.")
    assert not [s for s in find_spans("IBAN GB82 WEST 1234 5698 7654 33.") if s[0] == "account"]
    assert ("account", 12, 20) in find_spans("Account no. 12345678, thanks")
    assert find_spans("accounted 12345678 miscount 1") == []


def test_cases(spark, make_docs):
    docs = make_docs([None, "", "a@b.cd " * 20_000, "mail me: a@b.cd or +44 20 7946 0958", "clean"], [1, 1, 2, 3, None]).selectExpr("*", "1 as pii")
    rows = find_pii(docs).collect()
    assert [len(r["pii"]) for r in rows] == [0, 0, 20_000, 2, 0]
    assert find_pii(make_docs([])).collect() == []
    red = redact_pii(docs)
    assert red.columns == docs.columns
    assert [r["text"] for r in red.collect()][3:] == ["mail me: [EMAIL] or [PHONE]", "clean"]
    assert red.first()["text"] is None


def test_query(spark, sf):
    from cuemill.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_pii"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in want)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))  | {""}
