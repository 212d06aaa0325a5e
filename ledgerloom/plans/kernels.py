"""The order-dependent kernels over DataFrames: bounded lists go to one task, whole tables row by row in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.operators.packing import Unit, diversity_order, pack, source_window


def _units(pdf: pd.DataFrame) -> list[Unit]:
    return [Unit.make(id=f"{r.doc_id:020d}", kind="source", section="source", text=r.text, relevance=float(r.relevance), path=r.source) for r in pdf.itertuples()]


def diversity(best: DataFrame) -> DataFrame:
    """(doc_id, place, penalty) of a bounded list (doc_id, text, source, relevance)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = [u for pdf in batches for u in _units(pdf)]
        yield pd.DataFrame([(int(u.id), k, p) for k, (u, p) in enumerate(diversity_order(units), 1)], columns=["doc_id", "place", "penalty"])

    return best.mapInPandas(run, "doc_id long, place long, penalty double")


def packed(best: DataFrame, budget: int, text: str) -> DataFrame:
    """(doc_id, selected, reason, tokens) of a bounded list under a token budget."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = [u for pdf in batches for u in _units(pdf)]
        _, report = pack({"text": text}, units, budget)
        yield pd.DataFrame([(int(r["id"]), r["selected"], r["reason"], r["tokens"]) for r in report], columns=["doc_id", "selected", "reason", "tokens"])

    return best.mapInPandas(run, "doc_id long, selected boolean, reason string, tokens long")


def windows(docs: DataFrame, terms: Sequence[str], most: int) -> DataFrame:
    """(doc_id, first_line, last_line, n_bytes, partial): the window of each document around its best line."""
    terms = tuple(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                first, last, shown = source_window(r.text or "", 1, terms, most)
                out.append((r.doc_id, first, last, len(shown.encode()), shown != (r.text or "")))
            yield pd.DataFrame(out, columns=["doc_id", "first_line", "last_line", "n_bytes", "partial"])

    return docs.mapInPandas(run, "doc_id long, first_line long, last_line long, n_bytes long, partial boolean")
