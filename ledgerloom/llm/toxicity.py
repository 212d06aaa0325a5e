"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word is the mean of the embeddings of a few hashed features (the word, two
prefixes, a suffix).  Filters of widths 1, 2 and 3 run over the whole text, each
keeps its largest response (never below zero), and a logistic layer makes the
score.  Training sees a bounded sample of labelled rows (MAX_TOXIC, MAX_CLEAN,
MAX_BYTES); thresholds are calibrated by language on rows of the sample that
the weights were not fitted to.  Scores depend on the text alone.

Defined results: a null or empty text has the score of no responses at all;
with no labelled rows every score is the prior 0.5 * PRIOR; a language without
its own calibration uses the threshold of all languages.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import nested, slices, table, with_fields, with_text

#: Bounds of the training sample: rows of either label, and bytes of text.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 2500, 24 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
EPOCHS, STEPS, BATCH, RATE, SEED = 10, 600, 32, 0.05, 11
PRIOR = 0.1
#: Rows of a language that its own threshold needs, of either label.
LEAST_ROWS = 12
#: Words whose projections a worker keeps.
CACHE = 80_000

FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(FOLD).split() if text else []


def features(word: bytes) -> tuple[int, int, int, int]:
    h = xxhash.xxh3_64_intdigest
    return h(word) % BUCKETS, h(b"^" + word[:4]) % BUCKETS, h(b"^" + word[:6]) % BUCKETS, h(word[-4:] + b"$") % BUCKETS


class Vocabulary:
    """Numbers of words and their features; number 0 is the padding after a text."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.flat = array("H", (0, 0, 0, 0))

    @property
    def rows(self) -> np.ndarray:
        return np.array(self.flat, np.int64).reshape(-1, 4)

    def ids(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
            self.flat.extend(features(w))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def padded(texts: list[bytes | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with max(WIDTHS) - 1 paddings behind it, and where each begins."""
    words: list[bytes] = []
    begins = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        begins[i] = len(words)
        words += words_of(t)
        words += [b""] * (max(WIDTHS) - 1)
    begins[-1] = len(words)
    return vocabulary.ids(words), begins


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS each
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @staticmethod
    def fresh() -> Model:
        rng = np.random.Generator(np.random.PCG64(SEED))
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return Model(rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), filters, np.full(n, -0.1, np.float32), np.abs(rng.normal(0, 0.5, n)).astype(np.float32), -1.0)

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place in it; the padding adds nothing."""
        e = self.embeddings[rows].mean(axis=1)
        e[0] = 0
        return np.concatenate([e @ f[k] for f in self.filters for k in range(len(f))], axis=1)

    def pooled(self, ids: np.ndarray, begins: np.ndarray, table_: np.ndarray, step: int = 1 << 15, track: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, and (if tracked) the position where it is; texts of any length in steps."""
        n, count = len(begins) - 1, FILTERS * len(WIDTHS)
        best, where = np.full((n, count), -np.inf, table_.dtype), np.zeros((n, count), np.int64)
        over = max(WIDTHS) - 1
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            part = table_[np.concatenate([ids[lo : min(hi + over, len(ids))], np.zeros(over, np.int64)])]
            response, at = np.empty((hi - lo, count), table_.dtype), 0
            for f, width in enumerate(WIDTHS):
                r = sum(part[k : k + hi - lo, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(width))
                response[:, f * FILTERS : (f + 1) * FILTERS] = r
                at += width * FILTERS
            response[ids[lo:hi] == 0] = 0  # a window that begins in the padding would reach the next text
            first = int(np.searchsorted(begins, lo, side="right")) - 1
            last = int(np.searchsorted(begins, hi - 1, side="right")) - 1
            edges = np.maximum(begins[first : last + 1] - lo, 0)
            top = np.maximum.reduceat(response, edges, axis=0)
            better = top > best[first : last + 1]
            if track:
                for d in range(first, last + 1):
                    block = response[edges[d - first] : (edges[d - first + 1] if d < last else hi - lo)]
                    pos = block.argmax(axis=0) + edges[d - first] + lo
                    where[d] = np.where(better[d - first], pos, where[d])
            best[first : last + 1] = np.maximum(best[first : last + 1], top)
        return best, where

    def scores(self, best: np.ndarray) -> np.ndarray:
        hidden = np.maximum(best.astype(np.float64) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.weights.astype(np.float64) + self.offset, -30, 30)))


@dataclass
class Sample:
    """Numbered texts of the training rows, in an order that a seed fixes; the first fifth calibrates."""

    numbered: list[np.ndarray]
    rows: np.ndarray
    labels: np.ndarray
    langs: list[str | None]
    order: np.ndarray

    @staticmethod
    def of(texts: list[bytes], labels: np.ndarray, langs: list[str | None]) -> Sample:
        vocabulary = Vocabulary()
        numbered = [padded([t], vocabulary)[0].astype(np.int32) for t in texts]
        return Sample(numbered, vocabulary.rows, labels, langs, np.random.Generator(np.random.PCG64(SEED + 1)).permutation(len(texts)))

    @property
    def one_sided(self) -> bool:
        return not len(self.labels) or self.labels.min() == self.labels.max()


def fitted(sample: Sample, epochs: int = EPOCHS) -> Model:
    """Weights fitted to all rows; of one label alone, the prior."""
    if sample.one_sided:
        model = Model.fresh()
        model.weights[:] = 0
        p = 0.5 * PRIOR if not len(sample.labels) or not sample.labels.any() else 1 - 0.5 * PRIOR
        model.offset = float(np.log(p / (1 - p)))
        return model
    return fit(sample.numbered, sample.rows, sample.labels, sample.order, epochs)


def calibrated(sample: Sample, epochs: int = EPOCHS) -> tuple[float, dict[str, float]]:
    """The threshold of all rows and those by language, from a fifth of the rows scored with weights fitted to the others."""
    held, rest = np.sort(sample.order[: len(sample.order) // 5]), sample.order[len(sample.order) // 5 :]
    if sample.one_sided or not len(held) or sample.labels[rest].min() == sample.labels[rest].max():
        return 0.5, {}
    trial = fit(sample.numbered, sample.rows, sample.labels, rest, epochs)
    scores = []
    for lo in range(0, len(held), BATCH):
        batch = held[lo : lo + BATCH]
        begins = np.concatenate([[0], np.cumsum([len(sample.numbered[i]) for i in batch])])
        used, local = np.unique(np.concatenate([[0], *(sample.numbered[i] for i in batch)]), return_inverse=True)
        scores.append(trial.scores(trial.pooled(local[1:], begins, trial.projected(sample.rows[used]))[0]))
    return calibrate(np.concatenate(scores), sample.labels[held], [sample.langs[i] for i in held])


def train(texts: list[bytes], labels: np.ndarray, langs: list[str | None], epochs: int = EPOCHS) -> Model:
    """Calibrate thresholds on a fifth of the rows with weights fitted to the others, then fit the weights to all rows."""
    sample = Sample.of(texts, labels, langs)
    model = fitted(sample, epochs)
    model.threshold, model.thresholds = calibrated(sample, epochs)
    return model


def gradients(model: Model, local: np.ndarray, begins: np.ndarray, rows: np.ndarray, y: np.ndarray, of_text: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of a batch: f0.. (filters), b, w, o (offset), e (mean embedding of each row of `rows`).

    `local` numbers the words by their row, row 0 is the padding; `of_text` weighs the texts.
    """
    best, where = model.pooled(local, begins, model.projected(rows), track=True)
    hidden = np.maximum(best + model.bias, 0)
    p = 1 / (1 + np.exp(-(hidden @ model.weights + model.offset)))
    d = (p - y) * of_text
    d_hidden = d[:, None] * model.weights[None, :] * (hidden > 0)
    words = np.zeros((len(rows), DIM), model.embeddings.dtype)
    e = model.embeddings[rows].mean(axis=1)
    e[0] = 0
    found = {}
    for f, width in enumerate(WIDTHS):
        g = d_hidden[:, f * FILTERS : (f + 1) * FILTERS]
        w = where[:, f * FILTERS : (f + 1) * FILTERS]
        found[f"f{f}"] = np.zeros_like(model.filters[f])
        for k in range(width):
            u = local[np.minimum(w + k, len(local) - 1)]
            found[f"f{f}"][k] = np.einsum("bfd,bf->df", e[u], g)
            np.add.at(words, u, g[:, :, None] * model.filters[f][k].T[None, :, :])
    words[0] = 0
    return found | {"b": d_hidden.sum(0).astype(model.bias.dtype), "w": (d[:, None] * hidden).sum(0).astype(model.weights.dtype), "o": d.sum(), "e": words}


def fit(numbered: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, which: np.ndarray, epochs: int) -> Model:
    """Weights for the texts `which`, by Adagrad on batches of them, STEPS at least; both labels weigh the same."""
    model = Model.fresh()
    rng = np.random.Generator(np.random.PCG64(SEED + 2))
    fit = np.array(which)
    share = labels[fit].mean()
    weights = {"b": model.bias, "w": model.weights, **{f"f{i}": f for i, f in enumerate(model.filters)}}
    sums = {k: np.full(v.shape, 1e-6, np.float32) for k, v in weights.items()}
    e_sums = np.full(model.embeddings.shape, 1e-6, np.float32)
    offset_sum = 1e-6
    for _ in range(max(epochs, -(-STEPS * BATCH // len(fit)))):
        for lo in range(0, len(fit), BATCH):
            batch = rng.permutation(fit)[:BATCH] if lo + BATCH > len(fit) else fit[lo : lo + BATCH]
            ids = np.concatenate([numbered[i] for i in batch])
            begins = np.concatenate([[0], np.cumsum([len(numbered[i]) for i in batch])])
            used, local = np.unique(np.concatenate([[0], ids]), return_inverse=True)
            y = labels[batch]
            g = gradients(model, local[1:], begins, rows[used], y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(batch))
            for name, value in weights.items():
                sums[name] += g[name] * g[name]
                value -= RATE * g[name] / np.sqrt(sums[name])
            touched = np.flatnonzero(np.abs(g["e"]).sum(1))
            flat = rows[used[touched]].ravel()
            at, inverse = np.unique(flat, return_inverse=True)
            total = np.zeros((len(at), DIM), np.float32)
            np.add.at(total, inverse, np.repeat(g["e"][touched] / rows.shape[1], rows.shape[1], axis=0))
            e_sums[at] += total * total
            model.embeddings[at] -= 2 * RATE * total / np.sqrt(e_sums[at])
            offset_sum += g["o"] ** 2
            model.offset -= RATE * g["o"] / np.sqrt(offset_sum)
        rng.shuffle(fit)
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle between two neighbouring scores that has the best F1, and of such the widest gap."""
    s = np.unique(np.concatenate([[0.0], scores, [1.0]]))
    best = (-1.0, 0.0, 0.5)
    for low, high in zip(s[:-1].tolist(), s[1:].tolist(), strict=True):
        hit = scores >= high
        f1 = 2 * (hit & (labels == 1)).sum() / max(1, hit.sum() + labels.sum())
        best = max(best, (round(float(f1), 6), high - low, (low + high) / 2))
    return best[2]


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> tuple[float, dict[str, float]]:
    """The best threshold, and that of each language with rows enough."""
    overall, by_lang = best_threshold(scores, labels) if labels.min() < labels.max() else 0.5, {}
    by = np.array([x or "" for x in langs])
    for lang in sorted(set(by.tolist())):
        at = by == lang
        if lang and min(labels[at].sum(), (1 - labels[at]).sum()) >= LEAST_ROWS:
            by_lang[lang] = best_threshold(scores[at], labels[at])
    return overall, by_lang


#: What a training task does; Spark's hash sends these numbers to different ones of two partitions.
FIT, CALIBRATE = 0, 2


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit or calibrate on the rows of a part; the rows of each part are the whole sample."""
    by_part: dict[int, list[tuple]] = {}
    for b in batches:
        for part, *r in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text", "toxic", "lang")), strict=True):
            by_part.setdefault(part, []).append(tuple(r))
    for part, rows in by_part.items():
        rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
        kept, total = [], 0
        for r in rows:
            if total + len(r[1] or b"") <= MAX_BYTES:
                kept.append(r)
                total += len(r[1] or b"")
        sample = Sample.of([r[1] or b"" for r in kept], np.array([r[2] for r in kept], np.int64), [r[3] for r in kept])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(fitted(sample) if part == FIT else calibrated(sample))], pa.binary())], names=["part", "result"])


def fit_sample(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled documents; labels has doc_id and toxic.

    The sample is at most MAX_TOXIC + MAX_CLEAN rows, the first by a hash of
    their id; of these whole texts up to MAX_BYTES go to two tasks, one that
    fits the weights and one that calibrates the thresholds.
    """
    flat = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picks = []
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        picks.append(flat.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # at most MAX_TOXIC + MAX_CLEAN ids; of rows that share an id the longest text counts
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    found = docs.select("doc_id", "text", lang).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("doc_id", "toxic", "lang", F.col("text").cast("binary").alias("text"))
    one = found.groupBy("doc_id").agg(F.max_by(F.struct("text", "toxic", "lang"), F.struct(F.coalesce(F.octet_length("text"), F.lit(0)), "text")).alias("r"))
    twice = one.select(F.explode(F.array(F.lit(FIT), F.lit(CALIBRATE))).alias("part"), "doc_id", "r.text", "r.toxic", "r.lang").repartition(2, "part")
    results = {r["part"]: pickle.loads(bytes(r["result"])) for r in twice.mapInArrow(_train_task, "part int, result binary").collect()}
    if not results:
        return train([], np.zeros(0, np.int64), [])
    model = results[FIT]
    model.threshold, model.thresholds = results[CALIBRATE]
    return model


def _score(shared, field_: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        vocabulary, rows = Vocabulary(), np.zeros((0, FILTERS * sum(WIDTHS)), np.float32)
        for batch, texts in slices(with_text(batches, field_), "_text"):
            if len(vocabulary.number) > CACHE:
                vocabulary, rows = Vocabulary(), rows[:0]
            ids, begins = padded(texts, vocabulary)
            if len(vocabulary.number) > len(rows):
                new = np.array(vocabulary.flat[4 * len(rows) :], np.int64).reshape(-1, 4)
                more = model.projected(np.concatenate([np.zeros((1, 4), np.int64), new]))[1:]
                if not len(rows):
                    more[0] = 0
                rows = np.concatenate([rows, more])
            best, _ = model.pooled(ids, begins, rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.scores(best))], names=["row", "score"])

    return scan


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: `row` (its columns), score, threshold (of its language), toxic."""
    rows = nested(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_score(shared, "text"), with_fields(rows.schema["row"].dataType, ("score", "double")))
    threshold = F.lit(model.threshold)
    if "lang" in docs.columns:
        for lang, value in sorted(model.thresholds.items()):
            threshold = F.when(F.col("row.lang") == lang, value).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_sample(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity(docs, model)
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")
