import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import decontaminate
from tests.llm.conftest import odd_rows


def fold(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = fold(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, found = fold(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((str(d), len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def got(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return sorted((str(r.d), r.n_words, r.n, tuple(r["items"])) for r in df.select(F.col("row.doc_id").alias("d"), "n_words", n.alias("n"), "items").collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, docs, words, block_bytes):
    items = [(k, " ".join(words(n, 40))) for k, n in enumerate((25, 10, 11, 9, 3, 2, 1, 0, 60))] + [(20, None), (21, "Über ÉTÉ naïve 3.14 x-y_z"), (22, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    items.append((23, items[0][1]))
    rows = [(d, " ".join(words(30 + d, 40))) for d in range(20)]
    for d in range(20):
        piece = fold(items[d % len(items)][1])
        rows.append((100 + d, " ".join(words(d, 40)) + " , " + b"-".join(piece[d % 3 :]).decode() + "! " + " ".join(words(3, 40))))
    rows += odd_rows() + [(200, "ÜBER über été NAÏVE 3 14 X y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate(docs(rows), bench, block_bytes=block_bytes)) == brute(rows, items)


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert got(decontaminate(docs([(1, "a b")]), bench)) == [("1", 2, 0, ())]
    assert got(decontaminate(docs([]), bench)) == []
    assert decontaminate(docs([(1, "a b")]), bench).first().row["spans"] == "own spans"


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_items_without_an_id_hit_words(spark, docs, tmp_path, block_bytes):
    from ledgerloom.llm.decontaminate import op10_decontaminate

    items = [(None, "p q r"), (None, "s t u v"), (3, "q r s"), (None, None)]
    rows = [(1, "x p q r s t u v y"), (2, "p q r"), (3, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [(d, n, h, tuple(i)) for d, n, h, i in got(decontaminate(docs(rows), bench, block_bytes=block_bytes))] == [("1", 9, 7, ("3", None)), ("2", 3, 3, (None,)), ("3", 3, 0, ())]
    docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in op10_decontaminate(spark, str(tmp_path)).collect())
    assert found == [(1, 7, 2, True), (2, 3, 1, True), (3, 0, 0, False)]  # as OP10_SQL counts
