import random
import re

import numpy as np

from cuemill.llm import components, forest
from cuemill.llm.queries import QUERIES
from cuemill.llm.shared import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """doc_id -> (set sizes, component) by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(i, len(s), root(i)) for i, s in sets]


def varied(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in words]


def test_equals_all_pairs(spark, make_docs):
    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 30, 80]))]
        texts += [" ".join(varied(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))) for _ in range(rng.randint(1, 12))]
    hub = [f"h{i}" for i in range(120)]  # copies near the hub but hardly near each other
    texts += [" ".join(hub)] + [" ".join(varied(rng, hub, 0.045)) for _ in range(150)]
    texts += ["one", "ONE", "one two", "", " \n", texts[0].upper(), "long word " * 40_000, "word long " * 40_000]
    ids = random.Random(6).sample(range(5000), len(texts))
    for k in (2, 5):
        got = forest.near_duplicates(make_docs(texts, ids).selectExpr("*", "1 as component_id", "2 as id"), k=k).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(list(zip(ids, texts, strict=True)), k))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_nulls_repeats_and_empty(spark, make_docs):
    rows = forest.near_duplicates(make_docs([None, "a b c", "a b c", "a b c", "x y z", "x y z"], [1, 5, 5, None, 5, 3]), k=2).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows), key=str) == sorted([(1, 1, True), (5, 3, False), (5, 3, False), (None, None, True), (5, 3, False), (3, 3, True)], key=str)
    assert forest.near_duplicates(make_docs([]), k=2).collect() == []


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 200)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op7_lsh_forest"](spark, sf).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == sorted(brute(docs, 2))


def templated(rng, n, own, copies, changed):
    """n texts of one template with ``own`` words of their own in a row, and copies of some with the last words changed."""
    template = [f"t{i}" for i in range(100 - own)]
    texts = [template + [f"o{g}.{i}" for i in range(own)] for g in range(n)]
    texts += [t[: 100 - changed] + [f"c{rng.randrange(10**9)}" for _ in range(changed)] for t in texts[:copies]]
    return [" ".join(t) for t in texts]


def test_links_inside_a_dense_region(spark, make_docs):
    """Texts of one template at about 0.75 of each other, far more than ``crowd``, among them pairs at just over 0.8."""
    texts = templated(random.Random(8), 8000, 14, 400, 10)
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(make_docs(texts), k=2).collect()}
    assert all(got[8000 + i] == i for i in range(400)) and all(got[i] == i for i in range(8000))


def test_scattered_changes_in_a_dense_region(spark, make_docs):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(200)]
    change = lambda words, n, free: [f"c{rng.randrange(10**9)}" if i in at else w for at in [set(rng.sample(free, n))] for i, w in enumerate(words)]
    texts = [change(template, 10, range(1, 100, 2)) for _ in range(700)]
    texts += [change(t, 11, range(101, 199, 2)) for t in texts[:70]]
    texts = [" ".join(t) for t in texts]
    want = brute(list(enumerate(texts)), 2)
    assert sum(i != c for i, _, c in want) >= 70
    for crowd in (16, 4):
        got = forest.near_duplicates(make_docs(texts), k=2, crowd=crowd).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_dense_candidates_hold_every_link_of_two_classes(spark, make_docs):
    rng = random.Random(12)
    hub = [f"h{i}" for i in range(60)]
    docs = make_docs([" ".join(varied(rng, hub, 0.06)) for _ in range(120)])
    signed = forest.with_signatures(docs, "doc_id", "text", 2)
    texts = {r["doc_id"]: shingles(r["text"], 2) for r in docs.collect()}
    for labels in (3, 120):
        nodes = signed.selectExpr("doc_id as id", "n_shingles as n", "signature", f"doc_id % {labels} as label")
        sets = forest._sets(docs, "doc_id", "text", nodes, 2)
        links = {(a, b) for a in texts for b in texts if a < b and a % labels != b % labels and 5 * len(texts[a] & texts[b]) >= 4 * len(texts[a] | texts[b])}
        for block in (4096, 7):
            found = {(r["a"], r["b"]) for r in forest.dense_candidates(sets, nodes, 80, Scratch(spark), block).collect()}
            assert links and links <= found and all(a % labels != b % labels for a, b in found)


def test_leaves_get_deeper_where_it_is_crowded():
    order = np.array([[1, 1, 1, 1, x, y, 0, 0] for x, y in [(0, i) for i in range(9)] + [(1, 0), (1, 1), (2, 0)]] + [[1, 1, 1, 2, 0, 0, 0, 0]] * 3, np.uint8)
    order = np.ascontiguousarray(order).view(">u8").ravel().astype(np.uint64)
    leaf, dense = forest._leaves(np.zeros(len(order), np.int32), order, 4, 4)
    assert not dense.any() and leaf.tolist() == [*range(9), 9, 9, 10, 11, 11, 11]
    leaf, dense = forest._leaves(np.zeros(40, np.int32), np.zeros(40, np.uint64), 4, 4)
    assert dense.all() and leaf.tolist() == [i // 8 for i in range(40)]


def test_branches_cut_by_a_range_border_meet(spark):
    sig = bytes(forest.WIDTH)
    nodes = spark.createDataFrame([(i, sig) for i in range(12)], "id long, signature binary").repartition(3)
    chunks = {}
    for r in forest.tree_members(nodes, 16, 4).collect():
        chunks.setdefault(r["chunk"], set()).add(r["id"])
    linked = {frozenset((a, b)) for c in chunks.values() for a in c for b in c if a != b}
    assert len(linked) == 66


def test_words_that_collide_in_a_polynomial_hash(spark, make_docs):
    """The Thue-Morse word and its complement have one hash under any polynomial of odd base modulo 2**64."""
    for n in (10, 12):
        word = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
        texts = [word + " " + word, word.translate({97: 98, 98: 97}) + " " + word.translate({97: 98, 98: 97})]
        got = forest.near_duplicates(make_docs(texts), k=2).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1)]


def test_bounds_follow_percent(spark, make_docs):
    rng = random.Random(11)
    texts = [" ".join(varied(rng, [f"w{g}.{i}" for i in range(40)], 0.09)) for g in range(30) for _ in range(4)]
    for percent in (50, 70):
        got = forest.near_duplicates(make_docs(texts), k=2, percent=percent).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(list(enumerate(texts)), 2, percent))
