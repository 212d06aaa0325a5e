"""Content-addressed blobs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(rows: DataFrame, id_: str, content: str) -> DataFrame:
    """(content_hash, first_id, n_puts, byte_length): what a store holds after all rows were put; hashes move, contents do not."""
    hashed = rows.select(F.col(id_).alias("id"), F.sha2(content, 256).alias("content_hash"), F.octet_length(content).cast("long").alias("n"))
    return hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n_puts"), F.max("n").alias("byte_length"))


def state(content: str, content_hash: str, byte_length: str) -> Column:
    """What is wrong with a stored blob: its content (hash), its stated length, or nothing (valid)."""
    return F.when(F.coalesce(F.sha2(content, 256) != F.col(content_hash), F.lit(True)), "hash").when(F.octet_length(content) != F.col(byte_length), "length").otherwise("valid")
