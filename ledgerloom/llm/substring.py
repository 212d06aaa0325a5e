"""Substring dedup: difference-cover anchors that extend to exact 50-word windows.

A difference cover D modulo v has, for every shift d, two members that differ
by d.  Two equal windows of at least ANCHOR + v - 1 words therefore share an
anchor of ANCHOR words that begins at a cover position in both documents.  Only
anchors at cover positions (6 of 31) are hashed and shuffled; where an anchor
occurs in more than one document, the windows around it are hashed exactly and
the smallest doc_id of each is found.

Groups of any size stay linear: each task sends one row for a hash that it
knows (the first document that has it), so a hot anchor or window reaches its
reducer once a task, and no pairs are ever made.

Defined results: a null text has no words; a text of fewer than 50 words loses
nothing; a row without doc_id never counts as smaller than any other; equal
rows are judged alike, and rows of one doc_id do not count against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, nested, ranges, record_batch, remix, slices, split_words, table, unique_key, with_fields, with_text, word_hashes

WINDOW = 50
#: A perfect difference cover: every residue is a difference of two of these modulo the period.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Stands for a missing doc_id, above every other.
NO_ID = np.iinfo(np.int64).max
#: End of the span of a whole copy.
COPY = np.iinfo(np.int32).max
#: Anchors or windows that a task gathers before it sends them on.
BLOCK = 1 << 20


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for a window; the period shrinks for short windows."""
    for period, cover in ((PERIOD, COVER), (13, (0, 1, 3, 9)), (7, (0, 1, 3)), (1, (0,))):
        if window - period + 1 >= min(window, 16):
            return period, cover, window - period + 1
    raise ValueError(window)


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and the number of each row's group in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _anchors(window: int):
    period, cover, length = cover_of(window)
    in_cover = np.isin(np.arange(period), cover)
    schema = pa.schema([("h", pa.int64()), ("rk", pa.int64()), ("pos", pa.int32())])

    def send(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, rk, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order, group = _group(h)
        h, rk, pos = h[order], rk[order], pos[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        other = np.zeros(group[-1] + 1, bool)
        other[group[rk != rk[first][group]]] = True
        known = other[group]
        same = rk == rk[first][group]
        ask = first | (~known & same)  # a row of its own for each place, unless the task knows that it is shared
        key = np.where(ask, h, remix((h ^ (rk * 31 + pos)).view(np.uint64)).view(np.int64))
        return record_batch([key, rk, np.where(known, -1 - pos, pos).astype(np.int32)], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(length, 0xA24BAED4963EE407)
        held, n = [], 0
        for batch, texts in slices(batches, "text"):
            rks = np.asarray(batch.column("rk"))
            words, starts = split_words(texts)
            h = rolling(word_hashes(words)).view(np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(starts))
            pos = np.arange(len(words)) - starts[:-1][doc]
            left = starts[1:][doc] - np.arange(len(words))
            size = np.diff(starts)[doc]
            at = np.flatnonzero(in_cover[pos % period] & (left >= length) & (size >= window))
            if len(at):
                held.append((h[at], rks[doc[at]], pos[at]))
                n += len(at)
            if n >= BLOCK:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return scan


def _windows(window: int):
    _, _, length = cover_of(window)
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc", pa.int64()), ("rk", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, rk, s = (np.concatenate(x) for x in zip(*held, strict=True))
        order, group = _group(h1, h2, doc)
        h1, h2, doc, rk, s = h1[order], h2[order], doc[order], rk[order], s[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = doc[new][np.cumsum(new) - 1]
        ask = doc == least
        a = [x[ask] for x in (h1, h2, doc, rk, s)]
        yield record_batch([*a[:4], a[4].astype(np.int32), np.zeros(len(a[0]), np.int32)], schema)
        rk, s = rk[~ask], s[~ask]
        if len(s):
            order = np.lexsort((s, rk))
            rk, s = rk[order], s[order]
            new = np.concatenate([[True], (rk[1:] != rk[:-1]) | (s[1:] > s[:-1] + window)])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
            key = remix((rk[new] ^ s[new]).view(np.uint64))
            n = len(last)
            yield record_batch([key.view(np.int64), (key >> np.uint64(40)).astype(np.int32), np.full(n, NO_ID), rk[new], s[new].astype(np.int32), (s[last] + window).astype(np.int32)], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(window, 0xD1B54A32D192ED03), Rolling(window, 0x8CB92BA72F3D8DD7)
        held, n = [], 0
        for batch, texts in slices(with_text(batches), "_text"):
            rks, ids = np.asarray(batch.column("rk")), batch.column("row").field(batch.schema.field("row").type.get_field_index("doc_id"))
            docs = np.asarray(pc.fill_null(ids.cast(pa.int64()), NO_ID))
            anchors = batch.column("anchors")
            words, starts = split_words(texts)
            at = np.asarray(anchors.flatten(), dtype=np.int64)
            row = np.repeat(np.arange(len(texts)), np.asarray(anchors.value_lengths(), dtype=np.int64))
            low = np.maximum(at - (window - length), 0)
            high = np.minimum(at, np.diff(starts)[row] - window)
            edges = np.zeros(len(words) + 1, np.int64)
            ok = high >= low
            np.add.at(edges, (starts[row] + low)[ok], 1)
            np.add.at(edges, (starts[row] + high)[ok] + 1, -1)
            where = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            if len(where):
                w = word_hashes(words)
                doc = np.searchsorted(starts, where, side="right") - 1
                h2 = (two(remix(w ^ np.uint64(0x5851F42D4C957F2D)))[where] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held.append((one(w)[where].view(np.int64), h2, docs[doc], rks[doc], where - starts[doc]))
                n += len(where)
            if n >= BLOCK:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    return scan


def _cut(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(with_text(batches), "_text"):
            yield _cut_batch(batch, texts, window)

    return scan


def _cut_batch(batch: pa.RecordBatch, texts: list[bytes | None], window: int) -> pa.RecordBatch:
    n_words, n_removed, kept, cut = [], [], [], []
    for t, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
        words = t.split() if t else []
        n_words.append(len(words))
        if spans:
            merged, left, at = [], [], 0
            for a, b in sorted((x["s"], min(x["e"], len(words))) for x in spans if x["e"] != COPY or len(words) >= window):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                left += words[at:a]
                at = b
            words = left + words[at:]
            cut.append([{"start": a, "end": b} for a, b in merged])
        else:
            cut.append([])
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
    out = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return pa.RecordBatch.from_arrays(out, names=["row", "n_words", "n_removed", "kept", "removed"])


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rk, spans) of the words to remove; rows has rk (a key) and row (a document).

    A whole copy of a document with a smaller doc_id needs no windows: its one
    span has no end (COPY).
    """
    slim = rows.select("rk", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.unhex(F.md5(F.col("row.text").cast("binary"))).alias("digest"))
    firsts = slim.groupBy("digest").agg(F.min("doc").alias("least"))
    copies = slim.join(firsts, "digest").where("least < doc").select("rk").distinct()
    anchors = rows.select("rk", F.col("row.text").alias("text")).mapInArrow(_anchors(window), "h long, rk long, pos int")
    by_h = Window.partitionBy("h")
    shared = anchors.withColumn("shared", (F.col("pos") < 0) | (F.min("rk").over(by_h) != F.max("rk").over(by_h))).where("shared")
    places = shared.groupBy("rk").agg(F.collect_set(F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos"))).alias("anchors"))
    around = rows.join(places.join(copies, "rk", "left_anti"), "rk").select("rk", "row", "anchors")
    found = around.mapInArrow(_windows(window), "h1 long, h2 int, doc long, rk long, s int, e int")
    flagged = found.withColumn("least", F.min("doc").over(Window.partitionBy("h1", "h2"))).where("e > 0 or least < doc")
    spans = flagged.select("rk", "s", F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("s") + window).alias("e"))
    return spans.unionByName(copies.select("rk", F.lit(0).alias("s"), F.lit(COPY).alias("e"))).groupBy("rk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: `row` (its columns), n_words, n_removed, kept (the words left, one space apart), removed (word spans)."""
    rows = nested(docs)
    rows = rows.withColumn("rk", unique_key(rows, "row.doc_id", "row.text"))
    out = with_fields(rows.schema["row"].dataType, ("n_words", "long"), ("n_removed", "long"), ("kept", "string"), ("removed", "array<struct<start:long,end:long>>"))
    return rows.join(repeated_spans(rows, window), "rk", "left").select("row", "spans").mapInArrow(_cut(window), out)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
keyed AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k FROM win),
first AS (SELECT k, min(doc_id) AS least FROM keyed GROUP BY k),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM keyed JOIN first USING (k) WHERE least < doc_id)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)) AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
