"""MinHash near-dedup with ProbMinHash signatures.

A document is the weighted set of its shingles of five consecutive words (a
shorter text, if it has words, is one shingle); a shingle that occurs c times
weighs 1 + ln c.  Each shingle is a Poisson process whose rate is its weight,
and each arrival picks a register at random; a register holds the shingle that
reached it first.  A shingle stops as soon as its next arrival comes after the
last register is filled.  Two signatures agree in a register with the
probability Jaccard similarity of the documents.  Registers are banded, and
every candidate pair is verified with the exact probability Jaccard.

Defined results: texts without words (null too) are classes of their own; equal
texts are one class; a class is named by its smallest doc_id (a missing one
counts as largest).  Texts are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, materialize, nested, remix, slices, split_words, table, temporary, unique_key, word_hashes
from ledgerloom.llm.linking import components, merged, shared_buckets

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: By so much a sum of floats may miss the similarity that it stands for.
ROUNDING = 1e-9
NO_ID = np.iinfo(np.int64).max


def shingle_weights(texts: list[bytes | None], rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles of all texts, in order of text and hash."""
    words, starts = split_words(texts)
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(texts)), n)
    h = rolling(word_hashes(words))
    inside = np.flatnonzero(np.arange(len(h)) + SHINGLE <= starts[1:][doc[: len(h)]])
    doc, h = doc[inside], h[inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, np.array([xxhash.xxh3_64_intdigest(b" ".join(words[starts[i] : starts[i + 1]])) for i in short.tolist()], np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h, np.zeros(0)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    return doc[at], h[at], 1 + np.log(np.diff(np.concatenate([at, [len(h)]])))


def signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs x registers) of weighted sets."""
    first = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, np.uint64)
    t, rounds = np.zeros(len(h)), 0
    active = np.arange(len(h))
    while len(active):
        more = max(1, 8192 // len(active))  # few processes left: several arrivals of each at once
        r = (np.arange(rounds, rounds + more, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        random = remix(h[active][:, None] + r[None, :])
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[active][:, None]
        times = t[active][:, None] + np.cumsum(gaps, axis=1)
        t[active] = times[:, -1]
        slot = doc[active][:, None] * registers + (remix(random) % np.uint64(registers)).astype(np.int64)
        whose = np.broadcast_to(h[active][:, None], slot.shape)
        slot, times, whose = slot.ravel(), times.ravel(), whose.ravel()
        better = np.flatnonzero(times < first[slot])
        better = better[np.argsort(-times[better], kind="stable")]  # the earliest is written last
        first[slot[better]], who[slot[better]] = times[better], whose[better]
        last = first.reshape(n_docs, registers).max(axis=1)
        active = active[t[active] < last[doc[active]]]
        rounds += more
    return who.reshape(n_docs, registers)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets, given in order of hash."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    a, b = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    below = np.searchsorted(ratio, ratio, side="left")  # those with a smaller ratio count with a, the others with b
    sum_a, sum_b = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    return float(np.sum(1.0 / ((only_a + sum_a[below]) / a + (only_b + sum_b[-1] - sum_b[below]) / b)))


def is_similar(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray, threshold: float) -> bool:
    """Whether the probability Jaccard is the threshold or more; by counts where no shingle repeats, as the quotient of two counts rounds right."""
    if (wa == 1).all() and (wb == 1).all():
        shared = len(np.intersect1d(ha, hb, assume_unique=True))
        return shared > 0 and shared / (len(ha) + len(hb) - shared) >= threshold
    return probability_jaccard(ha, wa, hb, wb) >= threshold - ROUNDING


def _bands(bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(SHINGLE, 0xC2B2AE3D27D4EB4F)
        seen: set[int] = set()
        for batch, texts in slices(batches, "text"):
            nodes = np.asarray(batch.column("node"))
            if len(seen) > 500_000:
                seen.clear()
            fresh = []
            for i, node in enumerate(nodes.tolist()):  # of equal texts a task sends the first
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            doc, h, w = shingle_weights([texts[i] for i in fresh], rolling)
            if not len(h):
                continue
            present, doc = np.unique(doc, return_inverse=True)
            sig = signatures(doc, h, w, len(present), bands * rows).reshape(len(present), bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), sig.shape[:2])
            for k in range(rows):
                key = remix(key ^ sig[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
            key = remix(key)
            node = np.repeat(nodes[np.array(fresh)[present]], bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return scan


def _similar(threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(SHINGLE, 0xC2B2AE3D27D4EB4F)
        cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0
        for batch in batches:
            a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
            ta, tb = batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary())
            keep = np.zeros(len(a), bool)

            def of(node: int, texts: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
                nonlocal held
                if node not in cache:
                    if held > 1_000_000:
                        cache.clear()
                        held = 0
                    cache[node] = shingle_weights([texts[i].as_py()], rolling)[1:]
                    held += len(cache[node][0])
                return cache[node]

            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                keep[i] = is_similar(*of(x, ta, i), *of(y, tb, i), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return scan


#: Rows of a batch of shingles, and 64-bit words of a sketch.
ROWS_A_BATCH, SKETCH = 1 << 16, 8


def sketches(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs x SKETCH) words: each bit is the parity of the shingles that a hash sends to it.

    Where two sketches differ, the texts differ in a shingle of their own, so
    they differ in at least as many shingles as bits.
    """
    out = np.zeros((n_docs, SKETCH), np.uint64)
    bit = remix(h ^ np.uint64(0x51ED270B9F1D6E25))
    np.bitwise_xor.at(out, (doc, (bit % np.uint64(SKETCH)).astype(np.int64)), np.uint64(1) << (bit >> np.uint64(58)))
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, weight, sketch, h, share): the distinct shingles of a text, each with its share of the text's weight, in lists of bounded length."""
    rolling = Rolling(SHINGLE, 0xC2B2AE3D27D4EB4F)
    for batch, texts in slices(batches, "text"):
        node = np.asarray(batch.column("node"))
        doc, h, w = shingle_weights(texts, rolling)
        total = np.bincount(doc, w, len(texts)) if len(h) else np.zeros(len(texts))
        sketch = sketches(doc, h, len(texts)).view(np.int64)
        share = w / total[doc] if len(h) else w
        at = np.flatnonzero(np.concatenate([[len(h) > 0], doc[1:] != doc[:-1]])) if len(h) else np.zeros(0, np.int64)
        cuts = np.concatenate([np.arange(lo, hi, ROWS_A_BATCH) for lo, hi in zip(at, [*at[1:], len(h)], strict=True)]) if len(h) else at
        offsets = pa.array(np.concatenate([cuts, [len(h)]]), pa.int32())
        of = doc[cuts] if len(h) else cuts
        columns = [node[of], total[of], pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * SKETCH), pa.array(sketch[of].ravel())), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(share))]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["node", "weight", "sketch", "h", "share"])


def across_classes(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that can be similar, and all that are; nodes has node and class, texts node and text.

    A prefix-filtered join.  With S and T the shares that what two texts have in
    common has of either's weight, their probability Jaccard is at most
    1 / (1/S + 1/T - 1): each of its terms is at most 1 / (1/p + (1-T)/q) with
    the shingle's shares p and q, and such sums are largest where they are one
    term.  Shingles stand in order of rarity; if a share of x comes before the
    first common one, then S <= 1 - x.  So in both texts a common shingle stands
    among the rarest ones that add up to 1 - threshold, in one of them among
    those that add up to (1 - threshold) / (1 + threshold), and the two places
    together must allow the threshold.  Every shingle weighs 1 at least, so where
    texts differ in d shingles, S + T <= 2 - d / w with the greater weight w, and
    the bound is largest for S = T: d <= 2 * w * (1 - threshold) / (1 + threshold).
    Sketches tell a least d.
    Shingles that many texts have come last and bring few candidates; those of
    one class bring none.
    """
    lists = materialize(nodes.select("node").join(texts, "node").mapInArrow(_shares, "node long, weight double, sketch array<long>, h array<long>, share array<double>"), "shingles")
    shares = lists.select("node", F.explode(F.arrays_zip("h", "share")).alias("x")).select("node", "x.h", "x.share")
    df = shares.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    wide, narrow = 1 - threshold + ROUNDING, (1 - threshold) / (1 + threshold) + ROUNDING
    order = Window.partitionBy("node").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    # shingles of one text alone come first, and are no more than a sum
    common = shares.join(df, "h").withColumn("after", F.sum("share").over(Window.partitionBy("node"))).withColumn("before", 1 - F.col("after") + F.coalesce(F.sum("share").over(order), F.lit(0.0)))
    words = [F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]
    slim = lists.select("node", "weight", *words).distinct().join(nodes, "node")
    prefix = materialize(common.where(F.col("before") <= wide).select("node", "h", "before").join(slim, "node"), "prefixes")
    by_class = prefix.groupBy("h", "class").agg(F.count("*").alias("n"), F.min("before").alias("least")).groupBy("h")
    by_class = by_class.agg(F.count("*").alias("classes"), F.max(F.struct("n", "class"))["class"].alias("largest"), F.min("least").alias("least"))
    several = prefix.join(by_class.where((F.col("classes") > 1) & (F.col("least") <= narrow)).select("h", "largest"), "h")
    main = F.col("class") == F.col("largest")
    x, y = F.col("x.before"), F.col("y.before")
    differ = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    fits = (F.col("x.h") == F.col("y.h")) & (F.least(x, y) <= narrow) & (1 / (1 - x) + 1 / (1 - y) <= 1 + 1 / threshold + ROUNDING) & (differ <= 2 * narrow * F.greatest("x.weight", "y.weight"))
    # the largest class of a shingle meets the others, not itself
    others, mains = several.where(~main).alias("x"), several.where(main).alias("y")
    found = [others.join(mains, fits), others.join(several.where(~main).alias("y"), fits & (F.col("x.class") < F.col("y.class")))]
    pairs = [p.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")) for p in found]
    return pairs[0].unionByName(pairs[1]).distinct()


def near_classes(texts: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, component) of the texts that are near others; texts has node (a key of the text) and text.

    Stars first: each node is compared with the pivots of its buckets.  The
    nodes of buckets that still hold several classes are then compared across
    classes, with candidates from a prefix-filtered join.
    """
    found = materialize(texts.mapInArrow(_bands(bands, rows), "key long, node long").withColumn("main", F.lit(True)), "bands")
    shared = shared_buckets(found)
    needed = shared.select("node").distinct()
    once = materialize(texts.hint("merge").join(needed, "node", "left_semi").dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        ta, tb = once.select(F.col("node").alias("a"), F.col("text").alias("ta")), once.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        both = pairs.hint("merge").join(tb, "b").hint("merge").join(ta, "a").select("a", "b", "ta", "tb")
        return materialize(both.mapInArrow(_similar(threshold), "a long, b long"), "links")

    stars = shared.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    first = components(verified(stars))
    classed = shared.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class"))
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("top")).where("low < top").select("key")
    open_ = materialize(classed.join(mixed, "key", "left_semi").select("node", "class").distinct(), "open")
    return merged(first, verified(across_classes(open_, once, threshold)))


def has_words() -> Column:
    return F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Per document: `row` (its columns), node, class_id (smallest doc_id of its class), kept (it stands for the class), ties.

    Of the `ties` equal rows that would all stand for a class, each says kept; keep_one leaves one.
    """
    worded = has_words()
    rows = nested(docs).withColumn("doc", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)))
    key = unique_key(rows.where(worded), F.col("row.text"))
    rows = rows.withColumn("node", F.when(worded, key).otherwise(F.xxhash64(F.lit("no words"), "row.doc_id")))
    texts = rows.where(worded).select("node", F.col("row.text").alias("text"))
    with temporary(docs.sparkSession):
        of_node = _heads(rows, near_classes(texts, threshold))
    out = rows.join(of_node, F.col("node") == F.col("node_"))
    kept = (F.col("node") == F.col("head.node")) & (F.col("doc") == F.col("head.doc"))
    return out.select("row", "node", F.when(F.col("head.doc") != NO_ID, F.col("head.doc")).alias("class_id"), kept.alias("kept"), F.col("head.ties").alias("ties"))


def _heads(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node_, head): the document that stands for the class of each node."""
    least = rows.groupBy("node", "doc").agg(F.count("*").alias("ties")).groupBy("node").agg(F.min(F.struct("doc", "ties")).alias("least")).select("node", "least.*")
    named = materialize(least.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    heads = named.groupBy("component").agg(F.min(F.struct("doc", "node", "ties")).alias("head"))
    return materialize(named.join(heads, "component").select(F.col("node").alias("node_"), "head"), "classes", keep=True)


def keep_one(found: DataFrame) -> DataFrame:
    """The `row` of one document of each class; only rows that occur again are brought together, and rows without words all stay."""
    kept = found.where("kept")
    again = has_words() & (F.col("ties") > 1)
    return kept.where(~again).select("row").unionByName(kept.where(again).dropDuplicates(["node"]).select("row"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "class_id", "kept")
