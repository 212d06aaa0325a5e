"""Helpers shared by the training-data operators: chunked Arrow scans, word hashes, scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker looks at together; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="ledgerloom-"))
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold inside, by names with `__` for dots."""
    before = {k: spark.conf.get(k, None) for k in (n.replace("__", ".") for n in values)}
    for n, v in values.items():
        spark.conf.set(n.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Folders of the tables written within the innermost `temporary` block.
_BLOCKS: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, but for those to keep; nothing that is used later may read the others."""
    _BLOCKS.append([])
    try:
        yield
    finally:
        for path in _BLOCKS.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, what: str, files: int | None = None, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives executors.

    Small results become few files; `files` is for results whose size is known.
    """
    path = scratch(df.sparkSession, what)
    if _BLOCKS and not keep:
        _BLOCKS[-1].append(path)
    with settings(df.sparkSession, spark__sql__adaptive__coalescePartitions__parallelismFirst="false"):
        (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker; rows may be long.
BATCH_BYTES = "8m"


def nested(df: DataFrame) -> DataFrame:
    """All columns of df as the struct `row`, out of the way of the columns that operators add."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Unequal values that share their first hash; 10^10 values have some 3 such pairs.
MOST_CLASHES = 100_000


def unique_key(df: DataFrame, *parts: Column | str) -> Column:
    """A 64-bit key for the rows of df that equal parts share and that 128 bits of hash tell apart.

    Values whose first hash clashes (one in billions) get a key from both
    hashes; only such keys reach the driver, and MOST_CLASHES bounds them.
    """
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit(0x9E3779B9), *parts)
    seen = df.select(one.alias("one"), two.alias("two")).groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("top"))
    clashes = [r["one"] for r in seen.where("low < top").select("one").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many hashes clash")
    return F.when(one.isin(clashes), F.xxhash64(two, one)).otherwise(one) if clashes else one


def with_fields(row: T.StructType | T.DataType, *fields: tuple[str, str]) -> T.StructType:
    added = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))
    return T.StructType([T.StructField("row", row), *added])


def with_text(batches: Iterator[pa.RecordBatch], field: str = "text") -> Iterator[pa.RecordBatch]:
    """Each batch with a field of its struct `row` as the column _text."""
    for batch in batches:
        kind = batch.schema.field("row").type
        yield batch.append_column("_text", pc.struct_field(batch.column("row"), kind.get_field_index(field)))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch in slices of about `limit` bytes of `column`, with that column's values as bytes."""
    for batch in batches:
        col = batch.column(column)
        col = col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at), col.slice(at, to - at).to_pylist()
            at = to


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The words (runs without ASCII white space) of all texts, and where each text's begin (and the last's end)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            words += t.split()
        starts[i + 1] = len(words)
    return words, starts


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def remix(x: np.ndarray) -> np.ndarray:
    """A second hash of 64-bit hashes (finalizer with xor-shifts and two odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of `length` consecutive values, from prefix sums of value times power, modulo 2**64."""

    def __init__(self, length: int, base: int) -> None:
        self.length, self.base = length, base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n - 1, self.base, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n - 1, self.inverse, np.uint64))])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        n = len(values) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._powers(len(values))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)])])
        return remix((total[self.length :] - total[: -self.length]) * self.down[:n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count) for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def record_batch(arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
