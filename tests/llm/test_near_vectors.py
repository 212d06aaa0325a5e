import numpy as np

from ledgerloom.llm.near_vectors import PROBES, TABLES, bucket_keys, hadamard, near_vectors, unit


def brute(rows, cosine=0.95):
    n = len(rows)
    good = [v is not None and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) for _, v in rows]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    seen, label = set(), {}
    for i in range(n):
        if i not in seen:
            todo, part = [i], []
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    part.append(k)
                    todo += links[k]
            for k in part:
                label[k] = min(rows[k][0] for k in part)
    return [(rows[i][0], len(links[i]), label[i]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(hadamard(y), x)
    keys = bucket_keys(unit(np.repeat(x, 2, axis=0)), 3, 2, 4)
    assert keys.shape == (10, 3, 5) and (keys[::2] == keys[1::2]).all()


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, np.float32(rng.normal(size=64))) for k in range(200)]
    for c in range(12):
        center = rng.normal(size=64)
        center /= np.linalg.norm(center)
        for _ in range(15):
            noise = rng.normal(size=64)
            noise -= (noise @ center) * center
            rows.append((len(rows), np.float32(center + rng.uniform(0.02, 0.33) * noise / np.linalg.norm(noise))))
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(1000 + k, rows[210][1]) for k in range(4)] + [(1010, [2 * x for x in rows[215][1]])]
    want, got = brute(rows), {r.vec_id: r for r in near_vectors(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    total = sum(n for _, n, _ in want)
    assert total > 500 and sum(got[i].n_links for i, _, _ in want) >= 0.98 * total
    assert all(got[i].n_links <= n for i, n, _ in want)
    assert sum(got[i].component_id == c for i, _, c in want) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0]), (10, [2.0]), (11, [1e-30, 0.0]), (12, [-1.0, 0.0]), (13, [3e38, 1e37]), (8, [0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(frame(spark, rows)).collect())
    assert got == sorted(brute(rows))
    assert near_vectors(frame(spark, [])).count() == 0 and near_vectors(frame(spark, [(1, None)])).first().component_id == 1


def test_large_class_is_counted_in_blocks(spark, monkeypatch):
    from ledgerloom.llm import near_vectors as m

    monkeypatch.setattr(m, "BLOCK", 7)
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(k, [float(x) for x in np.float32(base + 0.01 * rng.normal(size=16))]) for k in range(40)] + [(100, [float(x) for x in np.float32(base)])] * 3
    got = near_vectors(frame(spark, rows)).collect()
    assert {r.n_links for r in got} == {42} and {r.component_id for r in got} == {0}


def test_recall_of_candidates_with_three_to_five_functions():
    """Shares of random pairs at the threshold that meet in a bucket; the number of functions grows with the table."""
    rng = np.random.default_rng(17)
    x = unit(rng.normal(size=(1500, 64)))
    noise = rng.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * noise
    for functions in (3, 4, 5):
        a, b = bucket_keys(x, TABLES, functions, PROBES), bucket_keys(y, TABLES, functions, PROBES)
        met = (a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))
        assert met.mean() >= 0.98, functions
