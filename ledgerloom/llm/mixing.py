"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a 48-bit hash.  Tokens are summed by source and by the top
12 bits of the hash; the bucket in which a source's budget runs out is refined
by the next 12 bits, and so on, so no level holds more than 4096 sums a source
and no documents are sorted.  A document is then filtered by comparing its hash
with its source's threshold.  Thresholds are nested: a larger budget keeps
every document that a smaller one keeps.

A source whose target is r times its size takes every document floor(r) times,
and once more those below the threshold.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents equal in doc_id and text share a hash and are taken
alike; with no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, nested, table

WEIGHTS, MOST = (5, 2, 1), 3
LEVELS, BITS = 4, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """48 bits, the same in any engine that has md5."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight; targets above `most` times the size stop there, the excess goes on by weight.

    The fixed point is min(cap, weight * level): sources in order of cap per
    weight are full until the level that the rest can carry lies below.
    One row a source goes through the two global windows.
    """
    by_name = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = by_name.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything).cast("double") - F.col("full")) / F.col("open"))
    # the first source in this order that is not filled tells the level; later ones would count unfilled caps
    opens = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "rank", "level")
    level = F.min(F.when(F.col("level") < F.col("cap") / F.col("weight"), opens)).over(everything)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * level, F.lit(0.0))).alias("target"))


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, base, edge, edge_in): take all base times, and again if hash < edge, or = edge where edge_in."""
    size, target = F.col("source_size"), F.col("target")
    base = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("base", base).withColumn("left", target - F.col("base") * size).withColumn("edge", F.lit(0).cast("long"))
    for level in range(LEVELS):
        below = (LEVELS - 1 - level) * BITS
        k = F.shiftright("hash", below)
        s = state.select("source", "source_size", "target", "base", "left", "edge").alias("s")
        inside = hashed.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("hash", below + BITS) == F.col("s.edge")))
        sums = inside.select("d.source", k.alias("k"), "size").groupBy("source", "k").agg(F.sum("size").alias("tokens"))
        order = Window.partitionBy("source").orderBy("k")
        sums = sums.withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).withColumnRenamed("source", "source_")
        edge = s.join(sums, F.col("s.source").eqNullSafe(F.col("source_")) & (F.col("before") <= F.col("s.left")) & (F.col("s.left") < F.col("before") + F.col("tokens")), "left")
        state = edge.select("s.source", "source_size", "target", "base", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), F.coalesce("k", F.lit(-1)).alias("edge"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        state = materialize(state, "mixing-level")  # one row a source; small plans instead of one that nests all levels
    return state.select("source", "source_size", "target", "base", "edge", ((F.col("left") * 2 >= F.col("tokens")) & (F.col("edge") >= 0)).alias("edge_in"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document: `row` (its columns), size, source_size, target, copies, taken (= copies * size)."""
    d = nested(docs)
    d = d.select("row", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"), doc_hash(F.col("row.doc_id"), F.col("row.text")).alias("hash"))
    hashed = materialize(d.select("source", "size", "hash"), "mixing-sizes")
    sizes = hashed.groupBy("source").agg(F.sum("size").alias("source_size"))
    chosen = thresholds(hashed, materialize(source_targets(sizes, weights, most), "mixing-targets")).withColumnRenamed("source", "source_")
    out = d.join(chosen, F.col("source").eqNullSafe(F.col("source_")))
    copies = F.col("base") + ((F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("edge_in"))).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST([5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM r),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - filled) / open AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (min(CASE WHEN level < cap / weight THEN struct_pack(a := cap / weight, b := rank, l := level) END) OVER ()).l, 0)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS remainder,
  sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN upto <= remainder OR (upto - tied <= remainder AND (remainder - (upto - tied)) * 2 >= tied) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
