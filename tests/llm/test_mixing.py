import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mix, source_targets
from tests.llm.conftest import odd_rows


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(full.values()), [s for s in names if s not in full]
        part = sum(w[s] for s in open_)
        target = full | {s: rest * w[s] / part for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 0}, {"z": 10, "é": 2000, None: 3, "B": 40}, {"a": 7}, {"a": 1, "b": 1, "c": 1, "d": 9000, "e": 2, "f": 2}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_taken_words_come_near_the_targets_and_reruns_agree(docs):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a"] * 6 + ["b", "c", None, "d"])) for k in range(3000)]
    first = mix(docs(rows)).select(F.col("row.doc_id").alias("d"), F.col("row.source").alias("s"), "size", "target", "copies", "taken", "source_size").collect()
    again = mix(docs(rows[::-1])).select(F.col("row.doc_id").alias("d"), "taken").collect()
    assert {r.d: r.taken for r in first} == {r.d: r.taken for r in again}
    sizes, taken = {}, {}
    for r in first:
        sizes[r.s] = sizes.get(r.s, 0) + r.size
        taken[r.s] = taken.get(r.s, 0) + r.taken
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
    want = water(sizes)
    assert {r.s: r.target for r in first} == pytest.approx(want) and {r.s: r.source_size for r in first} == sizes
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)


def test_odd_rows_and_empty_table(docs):
    got = mix(docs(odd_rows())).collect()
    assert len(got) == 9 and all(0 <= r.taken <= 3 * r["size"] for r in got) and got[0].row["taken"] == "own taken"
    assert mix(docs([])).count() == 0 and {r.taken for r in mix(docs([(1, None), (2, "")])).collect()} == {0}
