import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import Rolling, unique_key
from ledgerloom.llm.linking import components
from ledgerloom.llm.near_text import across_classes, is_similar, keep_one, near_duplicates, probability_jaccard, shingle_weights, signatures, sketches
from tests.llm.conftest import odd_rows


def weights(text):
    w = text.encode().split()
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    return {k: 1 + math.log(n) for k, n in c.items()}


def similarity(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def brute(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [weights(t or "") for _, t, *_ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (rows[i][1] == rows[j][1] or similarity(sets[i], sets[j]) >= threshold):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, *_) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), math.inf), math.inf if d is None else d)
    return sorted((str(d), least[root(k)] if least[root(k)] < math.inf else None) for k, (d, *_) in enumerate(rows))


def family(words, rng, n, size, change):
    base = words(size, 10**6)
    return [" ".join(w if rng.random() > change else f"z{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def test_exact_similarity():
    rng = random.Random(2)
    for _ in range(30):
        x = {k: rng.choice([1, 1, 1.7, 3]) for k in rng.sample(range(30), 12)}
        y = {k: rng.choice([1, 1, 1.7, 3]) for k in rng.sample(range(30), 15)}
        arrays = [np.array(v) for s in (x, y) for v in zip(*sorted(s.items()), strict=True)]
        assert probability_jaccard(*arrays) == pytest.approx(similarity(x, y))


def test_signatures_estimate_the_similarity():
    a = " ".join(f"a{k}" for k in range(300)) + " same line here again ok" * 20
    b = " ".join(f"a{k}" if k % 60 else f"b{k}" for k in range(300)) + " same line here again ok" * 3
    doc, h, w = shingle_weights([a.encode(), b.encode(), b"one", None, b""], Rolling(5, 12345))
    assert set(doc.tolist()) == {0, 1, 2}
    sig = signatures(doc, h, w, 3, 2000)
    want = similarity(weights(a), weights(b))
    assert np.mean(sig[0] == sig[1]) == pytest.approx(want, abs=0.04)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in edges:
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for x, y in edges if x != y for v in (x, y)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equals_brute_force(docs, words):
    rng = random.Random(9)
    texts = [t for n, size, change in ((12, 120, 0.01), (10, 60, 0.004), (6, 200, 0.03), (4, 8, 0.0), (25, 90, 0.02)) for t in family(words, rng, n, size, change)]
    texts += [" ".join(words(40)) for _ in range(15)] + ["tiny", "tiny text", "tiny"] + [texts[0]] * 5
    rng.shuffle(texts)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    found = near_duplicates(docs(rows))
    assert sorted((str(r.d), r.class_id) for r in found.select(F.col("row.doc_id").alias("d"), "class_id").collect()) == brute(rows)
    one = keep_one(found).select("row.*").collect()
    assert sorted(r.doc_id for r in one) == sorted({c for _, c in brute(rows)})
    assert one[0]["kept"] == "own kept"


def test_odd_rows_and_empty_table(docs):
    rows = [*odd_rows(), (8, "no id here " * 30), (8, "no id here " * 30)]
    found = near_duplicates(docs(rows))
    got = sorted((str(r.d), r.class_id) for r in found.select(F.col("row.doc_id").alias("d"), "class_id").collect())
    assert got == sorted([("1", 1), ("2", 2), ("3", 3), ("4", 4), ("4", 4), ("4", 4), ("5", 5), ("6", 6), ("8", 8), ("8", 8), ("None", 8)])
    kept = sorted((r.doc_id, r.text is None) for r in keep_one(found).select("row.doc_id", "row.text").collect())
    assert kept == [(1, True), (2, False), (3, False), (4, False), (4, False), (5, False), (6, False), (8, False)]
    assert near_duplicates(docs([])).count() == 0 and keep_one(near_duplicates(docs([]))).count() == 0


def test_hot_group_loses_no_link(docs, words):
    rng = random.Random(3)
    base = words(80, 10**6)
    chain = [list(base)]
    for _ in range(40):  # each is near the one before, ends are far apart
        nxt = list(chain[-1])
        nxt[rng.randrange(80)] = f"q{rng.randrange(10**6)}"
        chain.append(nxt)
    rows = [(k, " ".join(t)) for k, t in enumerate(chain)]
    found = near_duplicates(docs(rows)).select(F.col("row.doc_id").alias("d"), "class_id").collect()
    assert sorted((str(r.d), r.class_id) for r in found) == brute(rows)


def test_a_similarity_of_exactly_the_threshold_is_a_link(docs):
    one = lambda *ids: (np.array(ids, np.uint64), np.ones(len(ids)))
    for m in range(1, 200):
        a = one(*range(4 * m + m // 2))
        b = one(*range(4 * m), *range(10_000, 10_000 + m - m // 2))
        assert is_similar(*a, *b, 0.8) and not is_similar(*a, *one(*b[0].tolist(), 20_000), 0.8), m
        twice = [(h, w + math.log(2)) for h, w in (a, b)]  # all shingles occur twice: still 4m of 5m
        assert is_similar(*twice[0], *twice[1], 0.8), m
    assert not is_similar(*one(1), *one(2), 0.0)

    a = [f"a{k}" for k in range(19)]  # 15 shingles, of which the other has the first 12
    rows = [(1, " ".join(a)), (2, " ".join(a[:16]))]
    found = near_duplicates(docs(rows))
    assert {r.class_id for r in found.collect()} == {1} and keep_one(found).count() == 1


def test_rows_without_words_all_stay(docs):
    rows = [(None, None), (None, None), (None, ""), (7, " \n"), (7, " \n"), (7, None), (8, "one"), (8, "one")]
    kept = keep_one(near_duplicates(docs(rows))).select("row.doc_id", "row.text").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(d), str(t)) for d, t in rows[:7])


def test_prefixes_find_every_pair_across_classes(spark, words):
    rng = random.Random(13)
    passage = words(45, 10**6)  # all texts share it; it must bring no candidates by itself
    texts = [t for size, change in ((60, 0.015), (25, 0.01), (9, 0.05)) for t in family(words, rng, 12, size, change)]
    texts += [" ".join([*passage, *words(40, 10**6)]) for _ in range(12)]
    texts += [texts[0].replace(" ", " "), " ".join([texts[1]] * 2), texts[12] + " " + " ".join(texts[12].split()[:8])]
    nodes = list(dict.fromkeys(texts))
    classes = [rng.randrange(20) for _ in nodes]
    sets = [weights(t) for t in nodes]
    want = {(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if classes[i] != classes[j] and similarity(sets[i], sets[j]) >= 0.8}
    of_class = spark.createDataFrame([(k, 1000 + c) for k, c in enumerate(classes)], "node long, class long")
    got = {(r.a, r.b) for r in across_classes(of_class, spark.createDataFrame(list(enumerate(nodes)), "node long, text string"), 0.8).collect()}
    assert want and want <= got and all(classes[i] != classes[j] for i, j in got)
    by = [(set(k), len(k), sum(k.values())) for k in sets]
    assert all(len(by[i][0] ^ by[j][0]) * 0.6 <= 0.25 * max(by[i][2], by[j][2]) for i, j in got)  # few that are far apart
    shared = [k for k, t in enumerate(nodes) if t.startswith(" ".join(passage))]
    assert not got & {(i, j) for i in shared for j in shared}


def test_sketches_never_tell_more_than_texts_differ():
    rng = np.random.default_rng(6)
    for n in (3, 40, 300, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 7 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)])
        doc, h = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
        x, y = sketches(doc, h, 2)
        bits = sum(int(v).bit_count() for v in (x ^ y).tolist())
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (n < 40 or bits > 0)


def test_texts_whose_hashes_clash_stay_apart(docs, spark, monkeypatch):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    real = F.xxhash64
    monkeypatch.setattr(common.F, "xxhash64", lambda *parts: F.lit(7).cast("long") if len(parts) == 1 else real(*parts))
    keys = [r.k for r in rows.select("t", unique_key(rows, F.col("t")).alias("k")).orderBy("t").collect()]
    assert keys[1] == keys[2] and len(set(keys)) == 3


def test_intermediate_tables_are_deleted(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    found = near_duplicates(docs([(k, f"w{k} " + "the same words again and again " * 9) for k in range(30)]))
    assert [x.name.split("-")[0] for x in tmp_path.iterdir() if x.is_dir()] == ["classes"] and keep_one(found).count() == 1
