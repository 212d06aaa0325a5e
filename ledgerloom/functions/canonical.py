"""Canonical JSON, hashes and domain-tagged identifiers.

Identity rests on one text form of a JSON value: object keys in order of their
UTF-16 code units, no white space, numbers and strings in ECMAScript form,
non-ASCII characters as they are.  `to_json` cannot serve: it keeps the order of
struct fields and has another number format.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from json.encoder import encode_basestring
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Prefix of every hashed identifier.
TAG = "ledgerloom"
MAX_SAFE = 2**53 - 1


class CanonicalError(ValueError):
    """A value that has no canonical form."""


def number_text(x: int | float) -> str:
    """A finite number as ECMAScript prints it."""
    if isinstance(x, int):
        if abs(x) > MAX_SAFE:
            raise CanonicalError("integer beyond 2^53 - 1")
        return str(x)
    if not math.isfinite(x):
        raise CanonicalError("number is not finite")
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


_SURROGATE = re.compile("[\ud800-\udfff]")


def _string_text(s: str) -> str:
    text = encode_basestring(s)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text) if _SURROGATE.search(text) else text


def canonical_json(value: Any) -> str:
    """The canonical text of a JSON value; anything else is a CanonicalError."""
    open_: set[int] = set()
    out: list[str] = []
    add = out.append

    def write(v: Any) -> None:
        if isinstance(v, str):
            add(_string_text(v))
        elif v is None:
            add("null")
        elif v is True or v is False:
            add("true" if v else "false")
        elif isinstance(v, (int, float)):
            add(number_text(v))
        elif isinstance(v, (list, dict)):
            if id(v) in open_:
                raise CanonicalError("value contains itself")
            open_.add(id(v))
            if isinstance(v, list):
                add("[")
                for k, x in enumerate(v):
                    if k:
                        add(",")
                    write(x)
                add("]")
            else:
                if not all(isinstance(k, str) for k in v):
                    raise CanonicalError("key is not a string")
                keys = sorted(v) if all(map(str.isascii, v)) else sorted(v, key=lambda s: s.encode("utf-16-be", "surrogatepass"))
                add("{")
                for k, key in enumerate(keys):
                    add(("," if k else "") + _string_text(key) + ":")
                    write(v[key])
                add("}")
            open_.discard(id(v))
        else:
            raise CanonicalError(f"{type(v).__name__} is not a JSON value")

    write(value)
    return "".join(out)


def parse(text: str) -> Any:
    """JSON text as values that have a canonical form: integers beyond 2^53 - 1 are floats."""
    return json.loads(text, parse_int=lambda s: int(s) if abs(int(s)) <= MAX_SAFE else float(s))


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def content_hash(value: Any) -> str:
    return sha256(canonical_json(value))


def tagged_id(domain: str, *parts: Any) -> str:
    """Identifier of a kind of object, from the canonical list of its parts."""
    return content_hash([f"{TAG}:{domain}", *parts])


def event_id(hash_: str) -> str:
    return sha256(f"{TAG}:event:v1:{hash_}")


def new_uuid() -> str:
    return str(uuid.uuid4())


@pandas_udf(T.StringType())
def canonical_text(json_text: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where there is none."""

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else canonical_json(parse(s))
        except (CanonicalError, ValueError):
            return None

    return json_text.map(one)


def event_id_column(hash_: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{TAG}:event:v1:"), hash_), 256)


def quoted(text: Column) -> Column:
    """A JSON string literal of text, natively, for text without control characters."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def integer(number: Column) -> Column:
    return number.cast("long").cast("string")


def canonical_object(**fields: Column) -> Column:
    """Canonical text of an object whose values are canonical texts already; stays in the JVM."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if k else "{") + json.dumps(name) + ":"), fields[name]]
    return F.concat(*parts, F.lit("}"))


def dataset_digest(rows: Column) -> Column:
    """SHA-256 over the sorted hashes of row texts: one value for a set of rows, in any order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(rows, 256))), ","), 256)
