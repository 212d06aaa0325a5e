import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as hit_words
from tests.llm.conftest import CLASH, odd_rows
from tests.llm.test_near_text import brute as classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    items = [(k, " ".join(f"b{rng.randrange(10**5)}" for _ in range(30))) for k in range(5)]
    docs, labels = [], []
    for k in range(300):
        words = [f"c{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        toxic = k % 5 == 0
        if toxic:
            words[3] = words[9] = "scumbag"
        if k % 23 == 1:
            words += items[k % 5][1].split()[4:19]
        docs.append((k, " ".join(words), "en", f"src{k % 4}", 0))
        labels.append((k, 1, int(toxic)))
    for k in range(300, 330):  # copies and near copies of clean documents
        text = docs[(k - 300) * 5 + 2][1]
        docs.append((k, text if k % 2 else text + " extra", "en", "src0", 0))
    docs += [(400, None, None, None, None), (401, "", "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, labels, items


def test_every_stage_against_brute_force(spark, folder):
    d, docs, labels, items = folder
    now = spark.read.parquet(f"{d}/documents.parquet")
    names = now.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        path = f"{d}/out-{name}"
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        seen[name] = [tuple(r) for r in now.select(*names).collect()]
        was = [tuple(r) for r in before.select(*names).collect()]
        if name != "sharding":
            assert now.columns == names
        ids = sorted(r[0] for r in seen[name])
        if name == "toxicity":
            bad = {k for k, _, t in labels if t}
            assert ids == sorted(r[0] for r in docs if r[0] not in bad)
        elif name == "near_dedup":
            assert ids == sorted({c for _, c in classes([r[:2] for r in was])})
        elif name == "decontamination":
            hit = {i for i, _, n, _ in hit_words([r[:2] for r in was], items) if n}
            assert ids == sorted(r[0] for r in was if str(r[0]) not in hit) and hit
        elif name == "mixing":
            assert max(collections.Counter(ids).values()) <= 3 and set(ids) <= {r[0] for r in was}
        else:
            assert sorted(map(str, seen[name])) == sorted(map(str, was))
            slots = collections.defaultdict(list)
            for r in now.select("place.shard", "place.slot").collect():
                slots[r.shard].append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(str, (tuple(r) for r in run.select(*names).collect()))) == sorted(map(str, seen["sharding"]))


def test_empty_documents(spark, folder, tmp_path):
    d, *_ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where(F.lit(False) if t == "documents" else F.lit(True)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_repeated_rows_and_long_texts(spark, folder, tmp_path):
    d, docs, *_ = folder
    long = " ".join(f"c{k % 2999}" for k in range(60_000))
    rows = [r[:4] for r in docs[:60]] + [docs[1][:4]] * 3 + [(500, long, "en", "src1"), (500, long, "en", "src1"), (501, None, None, None), (501, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH], F.lit("own").alias("PLACE_"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*df.columns, "place__"] and {r.place for r in out.collect()} == {"own place"}
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert set(ids) <= {r[0] for r in rows} and 0 not in ids and ids[501] <= 2 * 3


@pytest.mark.parametrize("empty", ["labels", "benchmark"])
def test_empty_tables_beside_documents(spark, folder, tmp_path, empty):
    d, docs, *_ = folder
    odd = odd_rows()
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where(F.lit(t != empty)).write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in odd} and len(got) > 0


def test_mixing_by_a_brute_force_version(spark, folder):
    """Documents in order of their hash, as often as the target of their source allows."""
    d, docs, *_ = folder
    from ledgerloom.llm.mixing import doc_hash, mix

    df = spark.createDataFrame([r[:4] for r in docs], "doc_id long, text string, lang string, source string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", doc_hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    size = {r[0]: len((r[1] or "").split()) for r in docs}
    sources = sorted({r[3] for r in docs if r[3] is not None}) + [None]
    total = {s: sum(size[r[0]] for r in docs if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, everything, open_ = dict.fromkeys(sources, 0.0), sum(total.values()), set(sources)
    while open_:  # fill by weight; whoever is full stops there, and the rest goes on
        rest = everything - sum(target[s] for s in sources if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * total[s]}
        for s in full or open_:
            target[s] = min(3.0 * total[s], weight[s] * level)
        open_ = open_ - full if full else set()
    want = {}
    for s in sources:
        base = int(target[s] // total[s]) if total[s] else 0
        left = target[s] - base * total[s]
        for i in sorted((r[0] for r in docs if r[3] == s), key=hashes.get):
            take = size[i] <= left or 2 * left >= size[i]
            want[i] = base + (take and left >= 0 and total[s] > 0)
            left = left - size[i] if size[i] <= left else -1
    got = {r.d: r.copies for r in mix(df).select(F.col("row.doc_id").alias("d"), "copies").collect()}
    assert {k: v for k, v in got.items() if size[k]} == {k: v for k, v in want.items() if size[k]}
