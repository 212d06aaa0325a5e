"""Text functions: lexical terms, query normalisation, paths, token cost."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Words that a query does not search for.
STOP_WORDS = tuple("a an and are as at be by does for from how i if in is it of on or the this to using we what where why with work current".split())
# Modes of a query.
MODES = ("auto", "code", "memory", "impact", "continue")
# Extensions by language.
LANGUAGES = {".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".py": "python"}

MAX_TERMS, MAX_TEXT, MAX_IDS, MAX_BUDGET = 32, 4000, 200, 1_000_000


def _split_case(text: str) -> str:
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", text)


def _runs(text: str) -> list[str]:
    """Runs of letters, numbers and underscores."""
    out, run = [], []
    for c in text:
        if c == "_" or unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


def lexical_terms(text: str) -> list[str]:
    """Distinct lower-case words of a text, camel case and underscores split, in order."""
    words = _runs(_split_case(unicodedata.normalize("NFKC", text)).lower())
    return list(dict.fromkeys(w for run in words for w in run.split("_") if w))


def searchable(text: str) -> str:
    return f"{text} {' '.join(lexical_terms(text))}"


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function offers."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def terms_of(text: Column) -> Column:
    """lexical_terms in the JVM, for text that is in NFKC already (ASCII is)."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(spaced), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(F.flatten(F.transform(words, lambda w: F.split(w, "_"))), lambda w: w != ""))


def search_tokens(text: Column) -> Column:
    """Tokens of a search document: lower-case runs of letters and numbers, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_stop_words(terms: Column, most: int = MAX_TERMS) -> Column:
    return F.slice(F.filter(terms, lambda t: ~t.isin(*STOP_WORDS)), 1, most)


def token_cost(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def estimate_tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    found = F.lit(None).cast("string")
    for end, language in LANGUAGES.items():
        found = F.when(extension == end, language).otherwise(found)
    return found


def detect_language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return LANGUAGES.get(name[dot:].lower()) if dot > 0 else None


class PathError(ValueError):
    """A path that does not stay below its root."""


def normalize_path(path: str) -> str:
    """A relative path with forward slashes, without `.` parts; anything else is a PathError."""
    path = path.replace("\\", "/")
    if not path or "\0" in path or path.startswith("/") or re.match(r"[A-Za-z]:", path):
        raise PathError(path)
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise PathError(path)
    return "/".join(parts)


def infer_mode(text: str) -> str:
    if re.search(r"\b(affected|impact|breaks|callers|calls)\b", text, re.I | re.A):
        return "impact"
    return "continue" if re.match(r"continue\b", text, re.I | re.A) else "auto"


def mode_column(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\b(affected|impact|breaks|callers|calls)\b"), "impact").when(text.rlike(r"(?i)^continue\b"), "continue").otherwise("auto")


@dataclass(frozen=True)
class Query:
    """A checked and normalized retrieval query."""

    text: str
    terms: tuple[str, ...]
    mode: str
    budget: int = 2000
    session_id: str | None = None
    symbol_ids: tuple[str, ...] = ()
    memory_ids: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    historical: bool = False
    all_terms: tuple[str, ...] = field(default=())

    @property
    def phrase(self) -> str:
        return self.text.lower()

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\W_](?:[\w.$/\\-]*)|[\w.$/\\-]+", self.phrase)


def normalize_query(text: str, mode: str = "auto", budget: int = 2000, symbol_ids: tuple[str, ...] = (), memory_ids: tuple[str, ...] = (), files: tuple[str, ...] = (), historical: bool = False, session_id: str | None = None) -> Query:
    text = " ".join(unicodedata.normalize("NFKC", text).split())
    if not text or len(text) > MAX_TEXT:
        raise ValueError("a query has 1 to 4000 characters")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if not 1 <= budget <= MAX_BUDGET:
        raise ValueError("a budget is 1 to 1,000,000 tokens")
    if max(len(symbol_ids), len(memory_ids), len(files)) > MAX_IDS:
        raise ValueError("at most 200 seeds of a kind")
    everything = tuple(lexical_terms(text))
    terms = tuple(t for t in everything if t not in STOP_WORDS)[:MAX_TERMS]
    return Query(text, terms, infer_mode(text) if mode == "auto" else mode, budget, session_id, tuple(sorted(set(symbol_ids))), tuple(sorted(set(memory_ids))), tuple(sorted({normalize_path(f) for f in files})), historical, everything)
