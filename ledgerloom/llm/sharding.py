"""Sharding by a two-pass external shuffle.

Pass one counts bytes and rows; pass two scatters whole records by a seeded
hash into buckets of about BUCKET_BYTES, gives the records of each bucket the
places of a Fisher-Yates permutation, and writes them in that order.  Buckets
follow one another in one global order, which is cut into shards whose row
counts differ by one at most (law `rows`).

Buckets keep their size whatever the size of the data; a task takes one group
of them after another, and only the row count of each group (GROUPS at most)
reaches the driver.  A task holds the permutation of one bucket (8 bytes a
row), never its texts: Spark's sort brings the records into order and can
spill.

Defined results: a null text has 0 bytes; rows equal in doc_id and text are
interchangeable; shards may be empty where there are fewer rows than shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import nested, scratch, table

SHARDS, SEED, BUCKET_BYTES = 8, 20240607, 4 << 20
#: Groups at most; beyond, groups have more buckets. Groups of a task.
GROUPS, GROUPS_A_TASK = 50_000, 4


def _placed(shared, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] = shared.value  # the place at which each group begins
        group, bucket, begin, n, at, place = -1, -1, 0, 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            g, b, size = (np.asarray(batch.column(c)) for c in ("group", "bucket", "n"))
            positions = np.zeros(len(b), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if b[lo] != bucket:
                    begin = begin + n if g[lo] == group else first[g[lo]]
                    group, bucket, n, at = int(g[lo]), int(b[lo]), int(size[lo]), 0
                    # numpy's permutation is a Fisher-Yates shuffle of arange(n)
                    place = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)
                positions[lo:hi] = begin + place[at : at + hi - lo]
                at += hi - lo
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(positions)], names=["row", "place"])

    return scan


def shuffle_to_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, groups: int = GROUPS) -> DataFrame:
    """Write the documents as Parquet to path/shard=k, in random order, and read them: `row`, slot, shard."""
    spark = docs.sparkSession
    rows = nested(docs).withColumn("tie", F.xxhash64(F.lit(seed), "row.doc_id", "row.text"))
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    groups = min(buckets, groups)
    rows = rows.withColumn("bucket", F.pmod("tie", F.lit(buckets))).withColumn("group", F.pmod("bucket", F.lit(groups)).cast("int"))
    counts = {r["group"]: r["count"] for r in rows.groupBy("group").count().collect()}  # one row a group
    first = np.concatenate([[0], np.cumsum([counts.get(g, 0) for g in range(groups)])]).astype(np.int64).tolist()
    n = first[-1]
    scattered = rows.repartition(math.ceil(groups / GROUPS_A_TASK), "group").sortWithinPartitions("group", "bucket", "tie", "row.doc_id", F.xxhash64(F.lit(~seed), "row.text"))
    sized = scattered.select("row", "group", "bucket", F.count("*").over(Window.partitionBy("group", "bucket")).alias("n"))
    schema = rows.select("row", F.lit(0).cast("long").alias("place")).schema
    placed = sized.mapInArrow(_placed(spark.sparkContext.broadcast(first), seed), schema)
    # shard k holds the places from ceil(k * n / shards) on
    shard = F.floor((F.col("place") * shards) / F.lit(max(n, 1))) if n < 1 << 50 else F.floor(F.col("place").cast("decimal(30,0)") * shards / n)
    begin = F.element_at(F.array(*[F.lit(-(-k * n // shards)).cast("long") for k in range(shards)]), (F.col("shard") + 1).cast("int"))
    ready = placed.sortWithinPartitions("place").withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - begin)
    ready.select("row", "slot", "shard").write.partitionBy("shard").parquet(path)
    return spark.read.schema(ready.select("row", "slot", "shard").schema).parquet(path)


def op8_shard(spark, sf_dir: str) -> DataFrame:
    sharded = shuffle_to_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "shards"))
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return sharded.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
