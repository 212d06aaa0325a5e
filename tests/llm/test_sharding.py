import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import scratch
from ledgerloom.llm.sharding import SEED, shuffle_to_shards
from tests.llm.conftest import odd_rows


def run(spark, df, **options):
    return [(r["shard"], r["slot"], r["row"]) for r in shuffle_to_shards(df, scratch(spark, "t"), **options).collect()]


def test_law_order_and_whole_records(spark, docs):
    rows = [(k, f"text {k} " * (k % 9), "en", "s") for k in range(1003)]
    got = run(spark, docs(rows), bucket_bytes=4000)
    by = collections.defaultdict(list)
    for shard, slot, _ in got:
        by[shard].append(slot)
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r["doc_id"], r["text"]) for *_, r in got) == sorted((d, t) for d, t, *_ in rows) and got[0][2]["slot"] == "own slot"
    again = run(spark, docs(rows[::-1]), bucket_bytes=4000)
    assert {(s, k, r["doc_id"]) for s, k, r in got} == {(s, k, r["doc_id"]) for s, k, r in again}
    other = run(spark, docs(rows), bucket_bytes=4000, seed=1)
    assert {(s, k, r["doc_id"]) for s, k, r in got} != {(s, k, r["doc_id"]) for s, k, r in other}
    order = [r["doc_id"] for *_, r in sorted(got, key=lambda x: x[:2])]
    ascents = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 0.4 * len(order) < ascents < 0.6 * len(order)


def test_odd_rows_and_small_tables(spark, docs):
    rows = odd_rows()
    got = run(spark, docs(rows), shards=4)
    assert sorted(str(r["doc_id"]) for *_, r in got) == sorted(str(r[0]) for r in rows)
    assert collections.Counter(s for s, *_ in got) == {0: 3, 1: 2, 2: 2, 3: 2}
    assert run(spark, docs([])) == [] and len(run(spark, docs([(1, "x")]))) == 1


@pytest.mark.parametrize("groups", [1, 3, 50_000])
def test_equals_a_shuffle_of_each_bucket(spark, docs, groups):
    rows = [(k, f"text {k} " * (1 + k % 7), "en", "s") for k in range(700)]
    df = docs(rows)
    tie = F.xxhash64(F.lit(SEED), "doc_id", "text")
    hashed = [(r.doc_id, r.tie, r.other) for r in df.select("doc_id", tie.alias("tie"), F.xxhash64(F.lit(~SEED), "text").alias("other")).collect()]
    n = math.ceil(sum(len(r[1].encode()) + 1 for r in rows) / 1500)
    buckets = collections.defaultdict(list)
    for d, t, other in sorted(hashed, key=lambda x: (x[1], x[0], x[2])):
        buckets[t % n].append(d)
    used = min(n, groups)
    order = []
    for group in range(used):
        for b in sorted(b for b in buckets if b % used == group):
            place = np.random.Generator(np.random.PCG64([SEED, b])).permutation(len(buckets[b]))
            order += [d for _, d in sorted(zip(place.tolist(), buckets[b], strict=True))]
    edges = [math.ceil(k * len(rows) / 8) for k in range(9)]
    want = {(k, i, d) for k in range(8) for i, d in enumerate(order[edges[k] : edges[k + 1]])}
    assert {(s, i, r["doc_id"]) for s, i, r in run(spark, df, bucket_bytes=1500, groups=groups)} == want
