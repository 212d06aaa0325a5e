"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A hash function flips signs and applies the Walsh-Hadamard transform three
times, and names the coordinate of largest magnitude with its sign.  FUNCTIONS
of them make a bucket; a vector stands in its bucket of each table and also
looks into the PROBES buckets next best for it.  Candidate pairs are verified
by cosine in double precision; within a class all links are counted by blocks,
so a hot class costs no rows for its pairs.

Defined results: null, zero, or non-finite vectors (or with null components)
link with nothing; vectors of different dimension do not link; equal vectors
all link; rows of one vec_id count as separate vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, remix, table, temporary, unique_key
from ledgerloom.llm.linking import link

COSINE, TABLES, PROBES, SEED = 0.95, 12, 8, 7
#: Vectors of a class that are compared as one matrix.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def bucket_keys(x: np.ndarray, tables: int, functions: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Bucket keys (n x tables x (1 + probes)) of unit vectors: the own bucket first, then the next best."""
    n, d = x.shape
    width = 1 << max(0, d - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.Generator(np.random.PCG64([seed, width]))
    near = min(3, width)  # coordinates that a function may offer
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        names, losses = [], []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            top = np.argpartition(-np.abs(y), near - 1, axis=1)[:, :near]
            value = np.take_along_axis(y, top, 1)
            order = np.argsort(-np.abs(value), axis=1)
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            names.append(2 * top + (value < 0))
            losses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        combos = np.stack(np.meshgrid(*[np.arange(near)] * functions, indexing="ij"), -1).reshape(-1, functions)
        if len(combos) > 81:
            combos = combos[np.argsort(combos.sum(1), kind="stable")[:81]]
        loss = sum(losses[f][:, combos[:, f]] for f in range(functions))
        best = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
        key = np.full(best.shape, (t + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64) ^ np.uint64(d)
        for f in range(functions):
            key = remix(key ^ np.take_along_axis(names[f][:, combos[:, f]], best, 1).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        out[:, t, : best.shape[1]] = remix(key)
        out[:, t, best.shape[1] :] = out[:, t, :1]
    return out


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) for each dimension in the column."""
    size = np.asarray(column.value_lengths())
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        x = np.asarray(column.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), d)
        yield at, unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(tables: int, functions: int, probes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column("node"))
            for at, x in _matrices(batch.column("v")):
                for lo in range(0, len(at), 4096):
                    keys = bucket_keys(x[lo : lo + 4096], tables, functions, probes)
                    n = len(keys)
                    main = np.zeros(keys.shape, bool)
                    main[:, :, 0] = True
                    doubled = np.zeros(keys.shape, bool)
                    doubled[:, :, 1:] = keys[:, :, 1:] == keys[:, :, :1]
                    use = ~doubled.ravel()
                    node = np.repeat(nodes[at[lo : lo + 4096]], keys.shape[1] * keys.shape[2])
                    assert len(node) == n * keys.shape[1] * keys.shape[2]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)[use]), pa.array(node[use]), pa.array(main.ravel()[use])], names=["key", "node", "main"])

    return scan


def _close(cosine: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = batch.column("va"), batch.column("vb")
            same = np.asarray(va.value_lengths()) == np.asarray(vb.value_lengths())
            keep = np.zeros(batch.num_rows, bool)
            where = np.flatnonzero(same)
            if len(where):
                for (at, x), (_, y) in zip(_matrices(va.take(pa.array(where))), _matrices(vb.take(pa.array(where))), strict=True):
                    keep[where[at]] = (x * y).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return scan


def _count_block(cosine: float):
    def count(group: pa.Table) -> pa.Table:
        node, copies = np.asarray(group.column("node")), np.asarray(group.column("copies"))
        side, diagonal = np.asarray(group.column("side")), bool(group.column("i")[0].as_py() == group.column("j")[0].as_py())
        vectors = group.column("v").combine_chunks()
        links = np.zeros(len(node), np.int64)
        for at, x in _matrices(vectors):
            if diagonal:
                links[at] += (_linked(x, x, cosine) * copies[at][None, :]).sum(axis=1) - copies[at]
            else:
                a, b = side[at] == 0, side[at] == 1
                near = _linked(x[a], x[b], cosine)
                links[at[a]] += (near * copies[at[b]][None, :]).sum(axis=1)
                links[at[b]] += (near * copies[at[a]][:, None]).sum(axis=0)
        return pa.table({"node": pa.array(node), "links": pa.array(links)})

    return count


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows have cosine >= the threshold; near the threshold as one pair is computed elsewhere."""
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - cosine) < 1e-12)
    s[i, j] = (x[i] * y[j]).sum(axis=1)
    near = s >= cosine
    if x is y:
        np.fill_diagonal(near, True)
    return near


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Per row (vec_id, embedding): vec_id, n_links, component_id, kept."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", v.alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("fine"), unique_key(rows.where("fine"), "v")))
    ids = materialize(rows.select("vec_id", "node"), "vector-ids")
    with temporary(vectors.sparkSession):
        result = _node_links(rows.where("fine"), ids, cosine, tables, probes)
    out = ids.join(result, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _node_links(good: DataFrame, ids: DataFrame, cosine: float, tables: int, probes: int) -> DataFrame:
    """(node, n_links, component_id) of distinct vectors."""
    nodes = materialize(ids.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "nodes")
    n = nodes.count()
    once = good.select("node", "v").dropDuplicates(["node"])
    width = good.agg(F.max(F.size("v"))).first()[0] or 1
    sides = 2 * (1 << max(1, width - 1).bit_length())
    functions = max(1, math.ceil(math.log(16 * max(n, 1)) / math.log(sides)))

    def verify(pairs: DataFrame) -> DataFrame:
        va, vb = once.select(F.col("node").alias("a"), F.col("v").alias("va")), once.select(F.col("node").alias("b"), F.col("v").alias("vb"))
        return pairs.join(vb, "b").join(va, "a").select("a", "b", "va", "vb").mapInArrow(_close(cosine), "a long, b long")

    found = link(once.mapInArrow(_buckets(tables, functions, probes), "key long, node long, main boolean"), verify)
    classes = materialize(found.join(nodes, "node"), "classes")
    sizes = classes.groupBy("component").agg(F.count("*").alias("size"), F.min("least").alias("component_id"))
    placed = classes.select("node", "component", "copies").join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).join(once, "node")
    # a block meets itself and every other block once
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = placed.select("component", "node", "copies", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    counted = grid.groupBy("component", "i", "j").applyInArrow(_count_block(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    result = nodes.join(found.join(sizes.select("component", "component_id"), "component").select("node", "component_id"), "node", "left").join(counted, "node", "left")
    result = result.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    return materialize(result, "vector-links", keep=True)


def op4_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP4_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, least(min(y), x) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN k ON k.x = e.vec_id
"""
