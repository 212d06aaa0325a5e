"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `WINDOW` consecutive words of an item (an item of fewer words, but
not none, is one window).  Windows are sets of shingles; exact containment
needs all of them, so one necessary prefix shingle, the rarest in the corpus,
finds every document position where the window can be.  The position must
leave room for the window on both sides (positional and length bounds), and
the words are then compared one by one.

Defined results: a null text has no words; an item without words is never
found; equal items are all reported; equal document rows are judged alike;
items without an id hit words as others do, and all of them are one null in
`items`, which n_items counts as one and items_sha256 leaves out.
Other columns of the documents travel in the struct `row`, so their names
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import nested, ranges, slices, table, with_fields, with_text

WINDOW, SHINGLE = 10, 3
#: Item bytes whose index is broadcast together, on average; a larger benchmark is taken in several such blocks.
#: The index takes some 60 bytes for each of them, which the driver and every worker must hold.
BLOCK_BYTES = 4 << 20

#: A-Z lower-cased, other ASCII that is no digit or letter a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _order(item: str | None) -> tuple[bool, str]:
    """Item ids in order, a missing one last."""
    return item is None, item or ""


class ItemIndex:
    """The windows of a block of items, by the ids of their words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items}, key=_order)
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in folded_words(text)]
            if ids:
                size = min(window, len(ids))
                for s in range(len(ids) - size + 1):
                    found.setdefault(tuple(ids[s : s + size]), set()).add(number[item])
        self.windows = np.full((len(found), window), -2, np.int64)
        self.sizes = np.array([len(w) for w in found], np.int64)
        for k, w in enumerate(found):
            self.windows[k, : len(w)] = w
        self.owner_counts = np.array([len(x) for x in found.values()], np.int64)
        self.owner_starts = np.cumsum(self.owner_counts) - self.owner_counts
        self.owners = np.array([i for x in found.values() for i in sorted(x)], np.int64)
        # shingles of up to SHINGLE words, each length with a sorted table of keys of its own
        self.levels: dict[int, np.ndarray] = {}
        self.offset = 0
        for n in sorted({min(SHINGLE, s) for s in self.sizes.tolist()}):
            rows = self.windows[np.minimum(self.sizes, SHINGLE) == n]
            keys = np.concatenate([self._keys(rows[:, o : o + n])[(rows[:, o : o + n] >= 0).all(1)] for o in range(rows.shape[1] - n + 1)])
            self.levels[n] = np.unique(keys)
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        """A 64-bit key of each row of word ids; unequal rows may share one, as words are compared later."""
        key = ids[:, 0].astype(np.uint64)
        for k in range(1, ids.shape[1]):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[:, k].astype(np.uint64) + np.uint64(1)
        return key

    def choose(self, seen: dict[tuple[int, int], int]) -> None:
        """For each window the rarest shingle as its prefix; `seen` counts documents by (length, key number)."""
        for n, table_ in self.levels.items():
            which = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == n)
            counts = np.array([seen.get((n, k), 0) for k in range(len(table_))], np.int64)
            best, at = np.full(len(which), np.iinfo(np.int64).max), np.zeros(len(which), np.int64)
            key = np.zeros(len(which), np.int64)
            for o in range(self.windows.shape[1] - n + 1):
                part = self.windows[which, o : o + n]
                fits = (part >= 0).all(1)
                k = np.searchsorted(table_, self._keys(part)).clip(0, len(table_) - 1)
                better = fits & (counts[k] < best)
                best[better], at[better], key[better] = counts[k][better], o, k[better]
            order = np.argsort(key, kind="stable")
            per_key = np.bincount(key, minlength=len(table_))
            self.prefix[n] = (np.cumsum(per_key) - per_key, per_key, which[order], at[order])

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, key numbers) of the shingles of item windows among words with these ids."""
        for n, table_ in self.levels.items():
            ok = ids >= 0
            known = ok[: len(ids) - n + 1].copy()
            for k in range(1, n):
                known &= ok[k : len(ids) - n + 1 + k]
            at = np.flatnonzero(known)
            if len(at):
                keys = self._keys(np.stack([ids[at + k] for k in range(n)], axis=1))
                number = np.searchsorted(table_, keys).clip(0, len(table_) - 1)
                hit = table_[number] == keys
                yield n, at[hit], number[hit]

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and windows of all exact occurrences; ids of -1 stand between texts."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, at, number in self.occurrences(ids):
            first, count, which, offset = self.prefix[n]
            for part in range(0, len(at), 100_000):
                p, k = at[part : part + 100_000], number[part : part + 100_000]
                c = count[k]
                pick = ranges(first[k], c)
                w, s = which[pick], np.repeat(p, c) - offset[pick]
                fits = (s >= 0) & (s + self.sizes[w] <= len(ids))
                w, s = w[fits], s[fits]
                for k in range(self.windows.shape[1]):
                    if not len(w):
                        break
                    same = (k >= self.sizes[w]) | (ids[np.minimum(s + k, len(ids) - 1)] == self.windows[w, k])
                    w, s = w[same], s[same]
                starts.append(s)
                windows.append(w)
        return np.concatenate(starts), np.concatenate(windows)


def _chunk_ids(index: ItemIndex, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of a chunk, each text followed by a -1; where the texts begin; how many words they have."""
    words: list[bytes] = []
    begins, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        begins[i] = len(words)
        words += folded_words(t)
        counts[i] = len(words) - begins[i]
        words.append(b"")
    return index.word_ids(words), begins, counts


def _count_shingles(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        totals = {n: np.zeros(len(t), np.int64) for n, t in index.levels.items()}
        for _, texts in slices(batches, "text"):
            ids, begins, _ = _chunk_ids(index, texts)
            for n, at, number in index.occurrences(ids):
                doc = np.searchsorted(begins, at, side="right")
                totals[n] += np.bincount(np.unique(doc * len(totals[n]) + number) % len(totals[n]), minlength=len(totals[n]))
        for n, total in totals.items():
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int64)), pa.array(k), pa.array(total[k])], names=["n", "k", "docs"])

    return scan


def _find(shared, out: pa.Schema | None = None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch, texts in slices(with_text(batches), "_text"):
            ids, begins, counts = _chunk_ids(index, texts)
            s, w = index.matches(ids)
            edges = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edges, s, 1)
            np.add.at(edges, s + index.sizes[w], -1)
            items_by: dict[int, set[str | None]] = {}
            spans_by: dict[int, list[tuple[int, int]]] = {}
            if len(s):
                doc = np.searchsorted(begins, s, side="right") - 1
                c = index.owner_counts[w]
                pairs = np.unique(np.repeat(doc, c) * len(index.items) + index.owners[ranges(index.owner_starts[w], c)])
                for p in pairs.tolist():
                    items_by.setdefault(p // len(index.items), set()).add(index.items[p % len(index.items)])
                hit = np.cumsum(edges) > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
                for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
                    d = int(np.searchsorted(begins, a, side="right")) - 1
                    spans_by.setdefault(d, []).append((a - int(begins[d]), b - int(begins[d])))
            old_spans, old_items = batch.column("spans"), batch.column("items")
            spans, items = [], []
            for i in range(len(texts)):
                spans.append(_merged(spans_by.get(i, []), old_spans[i].as_py() if old_spans[i].is_valid else []))
                items.append(sorted(items_by.get(i, set()) | set(old_items[i].as_py() or []), key=_order))
            columns = {"row": batch.column("row"), "n_words": pa.array(counts), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def _merged(new: list[tuple[int, int]], old: list[dict]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted([*new, *((x["start"], x["end"]) for x in old)]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: `row` (its columns), n_words, spans (of hit words), items (found item_ids as strings).

    The items are broadcast in blocks of at most `block_bytes` (or one item);
    with more than one block the documents pass through one scan after
    another in the same task, each adding its spans and items.
    """
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = nested(docs).select("row", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = with_fields(out.schema["row"].dataType, ("n_words", "long"), ("spans", "array<struct<start:long,end:long>>"), ("items", "array<string>"))
    if not docs.columns:
        return out
    for block in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        index = ItemIndex([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.orderBy("item").collect()], window)
        if index.windows.size:
            counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count_shingles(spark.sparkContext.broadcast(index)), "n long, k long, docs long")
            index.choose({(r["n"], r["k"]): r["docs"] for r in counted.groupBy("n", "k").agg(F.sum("docs").alias("docs")).collect()})
        out = out.mapInArrow(_find(spark.sparkContext.broadcast(index)), schema)
    return out


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS s, w FROM d, sizes),
hits AS (SELECT doc_id, dw.s, dw.size, item_id FROM (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM dw) dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
