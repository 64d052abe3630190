"""Canonical JSON, normalised text and ids: what the built-in functions do not give."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Crockford's base-32 alphabet (fixed value).
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def number_text(x: float) -> str:
    """A number as JSON text the way ECMAScript prints it."""
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if exponent:
        e = int(exponent)
        if -7 < e < 0:
            return f"{x:.{len(mantissa.replace('.', '').lstrip('-')) - 1 - e}f}"
        return f"{mantissa.removesuffix('.0')}e{e:+d}"
    return mantissa


def canonical(value) -> str:
    """JSON with members sorted by UTF-16 code units, nulls kept, no spaces."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it does not parse."""
    return text.map(lambda x: None if x is None or (v := _parsed(x)) is None and x.strip() != "null" else canonical(v))


@F.pandas_udf(T.StringType())
def json_digest(text: pd.Series) -> pd.Series:
    """``sha256:`` and the hash of the canonical form."""
    return text.map(lambda x: None if x is None or (v := _parsed(x)) is None and x.strip() != "null" else "sha256:" + hashlib.sha256(canonical(v).encode("utf-8", "surrogatepass")).hexdigest())


def flat(value) -> list[str]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in (k, *flat(v))]
    if isinstance(value, list):
        return [x for v in value for x in flat(v)]
    return [] if value is None else [value if isinstance(value, str) else canonical(value)]


@F.pandas_udf(T.StringType())
def json_text(text: pd.Series) -> pd.Series:
    """All keys and values of JSON text, joined by spaces."""
    return text.map(lambda x: None if x is None else " ".join(flat(_parsed(x))))


def masked(value, sensitive):
    if isinstance(value, dict):
        return {k: "[redacted]" if any(s in k.lower() for s in sensitive) else masked(v, sensitive) for k, v in value.items()}
    return [masked(v, sensitive) for v in value] if isinstance(value, list) else value


def redact_json(*sensitive: str):
    """A function that masks the members whose key contains one of the words, at any depth."""

    @F.pandas_udf(T.StringType())
    def redact(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else canonical(masked(_parsed(x), sensitive)))

    return redact


@F.pandas_udf(T.StringType())
def normal_query(text: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed and trimmed."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).lower())


@F.pandas_udf(T.StringType())
def time_id(millis: pd.Series) -> pd.Series:
    """Ten base-32 characters that sort like the time in milliseconds."""
    return millis.map(lambda x: None if x is None or x != x else "".join(BASE32[int(x) >> 5 * k & 31] for k in range(9, -1, -1)))
