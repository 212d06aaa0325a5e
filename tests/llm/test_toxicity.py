import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity as tox
from tests.llm.conftest import odd_rows

BAD = {"en": ["idiotic", "scumbag", "moronic"], "de": ["xqzblob", "xqzblah", "xqzbluh"]}


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        words = [f"{lang}{rng.randrange(400)}" for _ in range(rng.randrange(5, 200))]
        toxic = k % 4 == 0
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD[lang]) + rng.choice(["", "!", ",", "###"]))
        out.append((k, " ".join(words), lang, int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = sample(400, 1)
    return tox.train([t.encode() for _, t, _, _ in rows], np.array([y for *_, y in rows]), [x for _, _, x, _ in rows])


def test_held_out_accuracy(spark, docs, model):
    rows = sample(300, 2)
    got = {r.d: r for r in tox.toxicity(docs([(d, t, x) for d, t, x, _ in rows]), model).select(F.col("row.doc_id").alias("d"), "score", "toxic").collect()}
    hit = sum((got[d].score >= 0.3) == bool(y) for d, *_, y in rows) / len(rows)
    by_threshold = sum(got[d].toxic == bool(y) for d, *_, y in rows) / len(rows)
    assert hit > 0.95 and by_threshold > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_whole_texts_count(docs, model):
    clean = " ".join(f"en{k % 400}" for k in range(200_000))
    got = {r.d: r.score for r in tox.toxicity(docs([(1, clean), (2, clean + " scumbag idiotic"), (3, clean[:3000])]), model).select(F.col("row.doc_id").alias("d"), "score").collect()}
    assert got[2] > got[1] and got[2] >= 0.3 > got[1]


def test_steps_and_cache_do_not_matter(model, monkeypatch):
    rows = [t.encode() for _, t, *_ in sample(40, 3)] + [b"", None, b"one"]
    v = tox.Vocabulary()
    ids, begins = tox.padded(rows, v)
    whole, where = model.pooled(ids, begins, model.projected(v.rows))
    parts, _ = model.pooled(ids, begins, model.projected(v.rows), step=37)
    assert np.allclose(whole, parts)
    alone = [model.scores(model.pooled(*tox.padded([r], u := tox.Vocabulary()), model.projected(u.rows))[0])[0] for r in rows]
    assert np.allclose(model.scores(whole), alone, atol=1e-5)


def test_fit_from_tables_is_bounded_and_repeatable(spark, docs, monkeypatch):
    monkeypatch.setattr(tox, "MAX_TOXIC", 40)
    monkeypatch.setattr(tox, "MAX_CLEAN", 60)
    rows = sample(300, 4)
    labels = spark.createDataFrame([(d, y) for d, *_, y in rows] + [(None, 1), (5, None), (7, 0), (10**6, 1)], "doc_id long, toxic int")
    df = docs([(d, t, x) for d, t, x, _ in rows] + [(3, "a second row"), (None, "x")])
    a, b = tox.fit_sample(df, labels), tox.fit_sample(df.repartition(5), labels)
    assert np.array_equal(a.embeddings, b.embeddings) and a.threshold == b.threshold
    empty = tox.fit_sample(df, labels.limit(0))
    got = tox.toxicity(docs(odd_rows()), empty).collect()
    assert len(got) == 9 and {round(r.score, 6) for r in got} == {0.05} and not any(r.toxic for r in got) and got[0].row["score"] == "own score"
    assert tox.toxicity(docs([]), a).count() == 0 and len(tox.toxicity(docs(odd_rows()), a).collect()) == 9


def test_gradients_against_differences(model):
    rows = [(t.encode(), y) for _, t, _, y in sample(12, 7)]
    v = tox.Vocabulary()
    ids, begins = tox.padded([t for t, _ in rows], v)
    used, local = np.unique(np.concatenate([[0], ids]), return_inverse=True)
    local, y = local[1:], np.array([y for _, y in rows])
    of_text = np.linspace(0.5, 1.5, len(y))
    doubled = tox.Model(model.embeddings.astype(np.float64), [f.astype(np.float64) for f in model.filters], model.bias.astype(np.float64), model.weights.astype(np.float64), -0.3)

    def loss():
        best, _ = doubled.pooled(local, begins, doubled.projected(v.rows[used]))
        z = np.maximum(best + doubled.bias, 0) @ doubled.weights + doubled.offset
        return float((of_text * (np.logaddexp(0, z) - y * z)).sum())

    g = tox.gradients(doubled, local, begins, v.rows[used], y, of_text)
    assert g["o"] == pytest.approx(difference(loss, doubled, "offset"), rel=1e-4, abs=1e-6)
    rng = np.random.default_rng(1)
    for name, value in (("b", doubled.bias), ("w", doubled.weights), *((f"f{i}", f) for i, f in enumerate(doubled.filters))):
        for _ in range(6):
            at = tuple(rng.integers(s) for s in value.shape)
            assert g[name][at] == pytest.approx(slope(loss, value, at), rel=1e-4, abs=1e-6), (name, at)
    features = np.zeros_like(doubled.embeddings)
    np.add.at(features, v.rows[used].ravel(), np.repeat(g["e"] / 4, 4, axis=0))
    for at in np.argwhere(np.abs(features) > 0.05)[:8]:
        assert features[tuple(at)] == pytest.approx(slope(loss, doubled.embeddings, tuple(at)), rel=1e-4, abs=1e-6)


def slope(loss, value, at, step=1e-6):
    kept = value[at]
    value[at] = kept + step
    up = loss()
    value[at] = kept - step
    down = loss()
    value[at] = kept
    return (up - down) / (2 * step)


def difference(loss, model, name, step=1e-6):
    kept = getattr(model, name)
    setattr(model, name, kept + step)
    up = loss()
    setattr(model, name, kept - step)
    down = loss()
    setattr(model, name, kept)
    return (up - down) / (2 * step)
