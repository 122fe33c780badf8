import hashlib
import random
import re
from collections import Counter

import pytest

from cuemill.llm import repeats, shared
from cuemill.llm.automaton import SuffixAutomaton
from cuemill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def cases():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(30)}"
    passages = [" ".join(word() for _ in range(rng.randint(20, 70))) for _ in range(6)]
    texts = [None, "", "a b", "x " * 200, "same text " * 3, "same text " * 3, " ".join(f"u{i}" for i in range(60_000))]
    for _ in range(120):
        texts.append("\n".join(rng.choice([rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(1, 5))))
    line = " ".join(f"l{i}" for i in range(20))
    texts += [" ".join(word() for _ in range(40)) + " " + line + " " + " ".join(word() for _ in range(40)) for _ in range(60)]
    return texts + texts[30:40]


def test_equals_brute_force(spark, make_docs):
    texts = cases()
    docs = make_docs(texts, [i // 2 for i in range(len(texts))]).selectExpr("*", "1 as repeats", "2 as row", "3 as m", "4 as d", "5 as `a.b`")
    for window, options in ((35, {}), (35, {"max_contexts": 5, "max_words": 500}), (6, {"max_contexts": 20, "max_words": 300})):
        got = repeats.remove_repeats(docs, window=window, **options)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "m", "d", "a.b", "repeats"]
        want = sorted((t or "", *b) for t, b in zip(texts, brute(texts, window), strict=True))
        assert sorted((r["text"] or "", *r["repeats"]) for r in got.collect()) == want


def test_empty(spark, make_docs):
    assert repeats.remove_repeats(make_docs([])).collect() == []
    assert not [t for t in spark.catalog.listTables() if "cuemill" in t.name]
    with pytest.raises(ValueError):
        repeats.remove_repeats(make_docs(["a"]), window=65)


def test_windows_of_64_words(spark, make_docs):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [" ".join(f"u{rng.random()}" for _ in range(n)) + " " + passage for n in (0, 1, 70, 90)] + [passage + " end"]
    got = repeats.remove_repeats(make_docs(texts), window=64).collect()
    assert sorted(tuple(r["repeats"]) for r in got) == sorted(brute(texts, 64))


def test_frequent_stretches_are_salted(spark, make_docs, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 3)
    texts = cases()[3:40] + [" ".join(f"l{i}" for i in range(45))] * 1500
    got = repeats.remove_repeats(make_docs(texts)).collect()
    assert sorted((r["text"] or "", *r["repeats"]) for r in got) == sorted((t or "", *b) for t, b in zip(texts, brute(texts, 35), strict=True))


def test_a_very_common_line_goes_through_automata(spark, make_docs, monkeypatch):
    """A line of 30 words among others in every text, some of its surroundings twice: its anchors have hundreds of contexts, its windows
    one or two."""
    rng = random.Random(11)
    line = " ".join(f"l{i}" for i in range(30))
    sides = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    texts = [f"{rng.choice(sides)} {line} {rng.choice(sides)}" for _ in range(300)]
    levels = []
    cut = repeats._cut_by_anchor
    monkeypatch.setattr(repeats, "_cut_by_anchor", lambda contents, window, run: levels.append(run) or cut(contents, window, run))
    got = repeats.remove_repeats(make_docs(texts), max_contexts=20).collect()
    assert sorted((r["text"], *r["repeats"]) for r in got) == sorted((t, *b) for t, b in zip(texts, brute(texts, 35), strict=True))
    assert levels == [18, 27, 35] and not hasattr(repeats, "single_masks")


def test_words_that_collide_in_a_polynomial_hash(spark, make_docs):
    """Thue-Morse words and their complements: one hash under any polynomial of odd base modulo 2**64."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(1 << 12))
    b = a.translate({97: 98, 98: 97})
    texts = [" ".join([*(f"w{i}" for i in range(34)), x]) for x in (a, b)] + [" ".join("xy"[(i.bit_count() + j) % 2] for i in range(64)) for j in (0, 1)]
    got = {r["doc_id"]: r["repeats"] for r in repeats.remove_repeats(make_docs(texts)).collect()}
    for i, (n, gone, kept) in enumerate(brute(texts, 35)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (n, gone, kept)


def test_automaton():
    rng = random.Random(8)
    for _ in range(200):
        rows = [([rng.randrange(3) for _ in range(rng.randint(0, 12))], rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 5))]
        automaton = SuffixAutomaton()
        for words, weight in rows:
            automaton.add(words, weight)
        automaton.finish()
        count = Counter()
        for words, weight in rows:
            for i in range(len(words)):
                for j in range(i + 1, len(words) + 1):
                    count[tuple(words[i:j])] += weight
        for words, _ in rows:
            want = [max((n for n in range(1, i + 1) if count[tuple(words[i - n : i])] > 1), default=0) for i in range(1, len(words) + 1)]
            assert automaton.repeated(words) == want


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, brute(docs.values(), 35), strict=True))
    rows = QUERIES["op9_repeated_passages"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
