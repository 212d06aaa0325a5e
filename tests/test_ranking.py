import math
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import Query, lexical_terms, mode_column, normalize_path, normalize_query, terms_of
from ledgerloom.operators import graph, packing, search
from ledgerloom.operators.graph import Edge, GraphConfig, bounded_bfs, personalized_pagerank
from ledgerloom.operators.packing import Unit, diversity_order, pack, similarity, source_window
from ledgerloom.plans.ranking import LocalIndex, fuse


def unit(id_, text, relevance=0.5, **more):
    return Unit.make(id=id_, kind="memory", section="project_state", text=text, relevance=relevance, **more)


def test_fusion(spark):
    fused = fuse({"a": ["x", "y"], "b": ["y", "x", "y"]})
    assert fused[0][0] == "x" and fused[0][1] == pytest.approx(1 / 61 + 1 / 62)
    lists = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "x", 2), ("b", "y", 3)], "channel string, id string, rank long")
    got = {r.id: (r.rrf, r.n_channels) for r in search.reciprocal_rank_fusion(lists).collect()}
    assert got["x"] == (pytest.approx(1 / 61 + 1 / 62), 2) and got["y"] == (pytest.approx(1 / 61 + 1 / 62), 2)
    tiers = search.candidates(search.reciprocal_rank_fusion(lists.replace("a", "exact", "channel")), 5).collect()
    assert all(r.priority == 1 and r.relevance == 1.0 for r in tiers)
    rest = search.candidates(search.reciprocal_rank_fusion(lists), 1).collect()
    assert [(r.id, r.priority, r.relevance) for r in rest] == [("x", 3, 1.0)]


def test_bounded_search_and_pagerank():
    star = [Edge(f"e{k:03}", "root", f"n{k:03}", "CALLS") for k in range(300)]
    found = bounded_bfs(star, ["root"], 1, 10)
    assert len(found) == 10
    random.Random(1).shuffle(star)
    assert list(bounded_bfs(star, ["root"], 1, 10)) == list(found)
    assert list(bounded_bfs(star, ["root"], 0, 10)) == ["root"]
    chain = [Edge("1", "a", "b", "CALLS"), Edge("2", "b", "c", "CALLS")]
    scores, paths, _ = personalized_pagerank(chain, ["c"], GraphConfig(max_hops=1, max_candidates=2), reverse=True)
    assert set(scores) == {"b", "c"} and sum(scores.values()) == pytest.approx(1)
    assert personalized_pagerank([], ["q"])[0] == {"q": 1.0} and personalized_pagerank(chain, [])[0] == {}
    assert [e.id for e in bounded_bfs(chain, ["a"], 3, 10)["c"]] == ["1", "2"]
    rng = random.Random(3)
    for _ in range(20):
        es = [Edge(f"{k}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["CALLS", "IMPORTS", "RELATED_TO"])) for k in range(30)]
        s, _, _ = personalized_pagerank(es, ["n1", "n2"])
        assert sum(s.values()) == pytest.approx(1)
        assert s == personalized_pagerank(es[::-1], ["n2", "n1"])[0]
    with pytest.raises(ValueError):
        GraphConfig(damping=1.0)


def test_a_loop_counts_twice(spark):
    loop = [Edge("1", "a", "a", "CALLS"), Edge("2", "a", "b", "CALLS")]
    scores = personalized_pagerank(loop, ["a"])[0]
    # a: 6 of its 9 to itself, 3 to b; b: all to a
    a = (0.15 + 0.85) / (1 + 0.85 / 3)
    assert scores == pytest.approx({"a": a, "b": 1 - a}, abs=1e-9)
    e = spark.createDataFrame([("a", "a", "CALLS"), ("a", "b", "CALLS")], "src string, dst string, type string")
    rounds = graph.pagerank_rounds(graph.ranking_steps(e), spark.createDataFrame([("a",)], "node string"), 120)
    assert {r.node: r.score for r in rounds.collect()} == pytest.approx(scores, abs=1e-6)
    back = graph.ranking_steps(e.unionByName(spark.createDataFrame([("a", "c", "RELATED_TO")], e.schema)), reverse=True)
    assert sorted((r.src, r.dst, r.weight) for r in back.collect()) == [("a", "a", 3.0), ("b", "a", 3.0)]


def test_channel_tables(spark):
    rows = [(1, "post", "Ledger.post", "i1", "function"), (2, "Post", "other.Post", "i2", "variable"), (3, "post", "post", "i3", "module"), (4, "balance", "Ledger.balance", "i4", "method")]
    df = spark.createDataFrame(rows, "k long, name string, qualified string, id string, kind string")

    def named(text):
        q = normalize_query(text)
        found = search.exact(df, q.phrase, q.words, [F.col("name"), F.col("qualified")], [F.col("id")], F.col("kind").isin("function", "method"), F.col("kind") == "module")
        return sorted(r.k for r in found.collect())

    assert named("post") == [1, 2] and named("i3") == [3] and named("why does Ledger.balance call post") == [1, 4] and named("ledger.post") == [1] and named("nothing") == []
    files = spark.createDataFrame([("src/Ledger.ts",), ("Ledger.ts",), ("x",)], "path string")
    assert sorted((r.path, r.whole) for r in search.containing_path(files, "path", "ledger.ts").collect()) == [("Ledger.ts", True), ("src/Ledger.ts", False)]
    assert search.containing_path(files, "path", "src\\ledger").count() == 1 and search.containing_path(files, "path", "see ledger.ts").count() == 0
    notes = spark.createDataFrame([(k, kind, k % 3, k != 5) for k, kind in enumerate(["question", "goal", "task", "artifact", "decision", "goal", "goal", "blocker", "action"])], "id long, kind string, since long, open boolean")
    got = search.project_state(notes, "kind", "since", "id", F.col("open"), 5)
    assert [r.id for r in got.collect()] == [1, 6, 2, 7, 4]


def test_similarity_of_evidence_in_both_forms(spark):
    rng = random.Random(12)
    some = lambda n: tuple(f"{rng.randrange(n)}" for _ in range(rng.randrange(0, 4)))
    units = []
    for k in range(25):
        start = rng.randrange(30)
        units.append(unit(f"u{k:02}", " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 5))), memory_ids=some(3), symbol_ids=some(4), event_ids=some(5), path=rng.choice([None, "p", "q"]), blob=rng.choice([None, "h", "g"]), start=start, end=start + rng.randrange(0, 20)))
    schema = "id string, memory_ids array<string>, blob string, first long, last long, symbols array<string>, terms array<string>, events array<string>, path string"
    df = spark.createDataFrame([(u.id, list(u.memory_ids), u.blob, u.start, u.end, list(u.symbol_ids), sorted(u.terms), list(u.event_ids), u.path) for u in units], schema)
    pairs = df.select(F.struct("*").alias("a")).crossJoin(df.select(F.struct("*").alias("b"))).select("a.id", F.col("b.id").alias("other"), search.evidence_similarity("a", "b").alias("s"))
    by = {u.id: u for u in units}
    assert all(r.s == pytest.approx(similarity(by[r.id], by[r.other])) for r in pairs.collect())


def test_graph_tables(spark):
    e = spark.createDataFrame([("a", "b", "CALLS", "1"), ("b", "c", "CALLS", "2"), ("a", "c", "IMPORTS", "3"), ("c", "d", "CALLS", "4")], "src string, dst string, type string, id string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.levels(e, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.node, r.hop) for r in graph.levels(e, spark.createDataFrame([("d",)], "node string"), 2, kinds=["CALLS"], reverse=True).collect()} == {("d", 0), ("c", 1), ("b", 2)}
    assert {r.node: r.path for r in graph.paths(e, seeds, 2).collect()}["d"] == ["a", "c", "d"]
    assert {r.node: (r.n_in, r.n_out) for r in graph.degrees(e).collect()} == {"a": (0, 2), "b": (1, 1), "c": (2, 1), "d": (1, 0)}
    both = e.select("src", "dst", F.lit(1.0).alias("weight")).union(e.select("dst", "src", F.lit(1.0)))
    scores = {r.node: r.score for r in graph.pagerank_rounds(both, seeds, 30).collect()}
    want = personalized_pagerank([Edge(i, s, d, "RELATED_TO") for s, d, i in (("a", "b", "1"), ("b", "c", "2"), ("a", "c", "3"), ("c", "d", "4"))], ["a"])[0]
    assert scores == pytest.approx(want, abs=1e-3) and sum(scores.values()) == pytest.approx(1)


def test_diversity_and_similarity():
    a, b, c = unit("a", "red green blue", 1.0), unit("b", "red green blue", 0.99), unit("c", "totally other words", 0.95)
    assert [u.id for u, _ in diversity_order([b, c, a])] == ["a", "c", "b"]
    x = unit("x", "p", blob="h", start=0, end=10)
    assert similarity(x, unit("y", "q", blob="h", start=0, end=20)) == 1.0 and similarity(x, unit("x", "z")) == 1.0
    assert similarity(unit("1", "one", path="p"), unit("2", "two", path="p")) == 0.15
    assert packing.ranked_metrics(["a", "b"], ["b", "c"], 2) == (0.5, 0.5) and packing.recall(["a"], ["a", "b"]) == (False, 0.5, ["b"])


def test_packing_is_monotone_and_never_over():
    units = [unit(f"u{k:02}", " ".join(f"w{k}x{j}" for j in range(5 + 7 * k)), 1 - k / 40, memory_type="goal" if k == 3 else None, event_ids=(f"{k:064x}",)) for k in range(20)]
    chosen = []
    for budget in (1, 100, 500, 1000, 2000, 8000):
        packet, report = pack({"text": "q"}, units, budget)
        assert packet["token_count"] <= budget or packet["budget_insufficient"]
        assert {r["reason"] for r in report} <= {"selected", "budget", "redundant"}
        chosen.append(sum(r["selected"] for r in report))
        if budget >= 2000:
            assert not packet["budget_insufficient"] and any(r["id"] == "u03" and r["selected"] for r in report)
    assert chosen == sorted(chosen) and chosen[-1] == 20
    same = [unit("a", "one two three four"), unit("b", "one two three four", 0.4, blob="z", start=0, end=4)]
    assert pack({"text": "q"}, [same[0], Unit(**{**same[0].__dict__, "id": "c", "memory_ids": ()})], 4000)[0]["budget_insufficient"] is False


def test_source_window():
    text = "".join(f"line {k} filler text\n" for k in range(200)) + "the login handler\n" + "tail\n" * 50
    first, last, shown = source_window(text, 10, {"login"}, 200)
    assert "login" in shown and len(shown.encode()) <= 200 and first == 10 + 199 and last >= first
    assert source_window("a\nb", 5, set(), 200) == (5, 6, "a\nb")


def test_text(spark):
    assert lexical_terms("getHTTPResponse_code Ünïx ﬁle x2Y") == ["get", "http", "response", "code", "ünïx", "file", "x2", "y"]
    words = ["getHTTPResponse_code", "camelCaseABC", "plain words_here", "A1b2C3", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.t for r in df.select(terms_of(F.col("w")).alias("t")).collect()] == [lexical_terms(w) for w in words]
    q = normalize_query("  What CALLS\tcreateSession? ")
    assert isinstance(q, Query) and (q.mode, q.terms) == ("impact", ("calls", "create", "session"))
    assert normalize_query("continue the work").mode == "continue" and normalize_query("recalls").mode == "auto"
    assert [r.m for r in spark.createDataFrame([("what is affected",), ("Continue x",), ("other",)], "t string").select(mode_column(F.col("t")).alias("m")).collect()] == ["impact", "continue", "auto"]
    for bad in ("../x", "a/../b", "C:\\x", "/x", "\\\\h\\s", ".", "", "a\0b"):
        with pytest.raises(ValueError):
            normalize_path(bad)
    assert normalize_path("src\\a/./b.ts") == "src/a/b.ts"
    for bad in (dict(text=" "), dict(text="x", budget=0), dict(text="x", mode="no"), dict(text="x" * 4001)):
        with pytest.raises(ValueError):
            normalize_query(**bad)


def test_bm25_matches_a_search_engine(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(["common"] * (k % 30 != 0) + rng.choices(words, k=rng.randrange(3, 40)))) for k in range(300)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(body)")
    db.executemany("insert into t(rowid, body) values (?, ?)", docs)
    terms = ["w1", "w2", "common", "w39"]
    want = dict(db.execute("select rowid, bm25(t) from t where t match ?", (" OR ".join(terms),)))
    df = spark.createDataFrame(docs, "id long, body string")
    got = {r.doc_id: r.score for r in search.bm25(df, "id", "body", terms).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    path = str(tmp_path / "index")
    assert search.open_index(spark, path) is None and search.ensure_index(df, "id", "body", path, parts=4, spread=2)
    index = search.open_index(spark, path)
    assert {r.doc_id: r.score for r in index.bm25([*terms, "w1"]).collect()} == pytest.approx(want, abs=1e-9) and index.bm25([]).count() == 0
    assert {r.doc_id: r.n for r in index.overlap(terms).collect()} == {k: n for k, t in docs if (n := len(set(terms) & set(t.split())))}
    asked = index.of(["w1"])
    assert "PartitionFilters: [" in (plan := asked._jdf.queryExecution().toString()) and "term" in plan and {r.part for r in asked.select("part").distinct().collect()} < set(range(4))
    # the same documents in another order need no new version; others do, and so does force
    assert not search.ensure_index(df.orderBy(F.col("id").desc()), "id", "body", path) and search.ensure_index(df, "id", "body", path, force=True)
    fewer = df.where("id < 200")
    assert search.ensure_index(fewer, "id", "body", path)
    newest = search.open_index(spark, path)
    assert newest.documents == 200 and {r.doc_id: r.score for r in newest.bm25(terms).collect()} == pytest.approx({r.doc_id: r.score for r in search.bm25(fewer, "id", "body", terms).collect()}, abs=1e-9)
    assert {r.doc_id: r.score for r in index.bm25(terms).collect()} == pytest.approx(want, abs=1e-9)  # a version stays as it was
    assert search.ensure_index(df.where("id < 0"), "id", "body", str(tmp_path / "none")) and search.open_index(spark, str(tmp_path / "none")).bm25(terms).count() == 0
    counts = {(r.doc_id, r.term): r.tf for r in search.postings(df, "id", "body").collect()}
    assert counts == {(k, w): n for k, t in docs for w, n in Counter(t.split()).items()}
    assert LocalIndex(dict(docs)).scores(terms) == pytest.approx(want, abs=1e-9)
    assert search.bm25(df, "id", "body", []).count() == 0


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(7)
    docs = [(k, rng.sample([f"t{j}" for j in range(12)], rng.randrange(1, 7))) for k in range(60)]
    want = {(a, b) for a, x in docs for b, y in docs if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    got = search.similar_pairs(spark.createDataFrame(docs, "id long, t array<string>"), "id", "t", 0.5).collect()
    assert {(r.a, r.b) for r in got} == want
    edge = [(1, [f"x{k}" for k in range(25)]), (2, [f"x{k}" for k in range(18, 25)])]  # exactly 7 of 25, and 0.28 * 25 > 7 in floating point
    assert [(r.a, r.b) for r in search.similar_pairs(spark.createDataFrame(edge, "id long, t array<string>"), "id", "t", 0.28).collect()] == [(1, 2)]
    assert packing.utility(0, 0) == 0.001 and math.isclose(packing.utility(1, 4), 0.5)
