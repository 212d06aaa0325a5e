import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.substring import COVER, NO_ID, PERIOD, cover_of, drop_repeats
from tests.llm.conftest import odd_rows


def brute(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        d = NO_ID if d is None else d
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (NO_ID if d is None else d) for p in range(s, s + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, window):
    found = drop_repeats(df, window)
    rows = found.select(F.col("row.doc_id").cast("string").alias("d"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).collect()
    return sorted((str(r.d), r.n_words, r.n_removed, r.h) for r in rows)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    for w in (1, 7, 8, 20, 30, 50, 64):
        period, cover, length = cover_of(w)
        assert length >= 1 and {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [4, 22, 50])
def test_equals_brute_force(docs, words, window):
    passages = [words(window + k, 10**6) for k in (0, 1, 5, 40)]
    rows = []
    for d in range(40):
        parts = words(d % 13)
        for k in range(d % 4):
            parts += passages[(d + k) % 4] + words(d % 7)
        rows.append((d * 3 % 41, " ".join(parts)))
    rows += [(100 + k, rows[5][1]) for k in range(6)] + [(7, rows[9][1]), (50, rows[9][1] + " end"), (51, "again and again " * window)]
    assert got(docs(rows), window) == brute(rows, window)


def test_odd_rows_and_empty_table(docs):
    rows = odd_rows() + [(9, "no id here " * 30)]
    assert got(docs(rows), 50) == brute(rows, 50)
    assert got(docs([]), 50) == []


def test_own_columns_stay(docs):
    r = drop_repeats(docs([(1, "a b")])).first()
    assert r.row["rk"] == "own rk" and r.row["kept"] == "own kept" and r.kept == "a b" and r.removed == []
