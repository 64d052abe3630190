"""Scalar functions that the operators share, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(query: Column) -> Column:
    """Lower-cased words of a query, empty ones dropped."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != "")


def snippet(text: Column, size: int = 240) -> Column:
    return F.substring(text, 1, size)


def normal_path(path: Column) -> Column:
    """Slashes for backslashes, one for several, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^\./", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)$", 1))


def clean(text: Column) -> Column:
    """Without emphasis marks and link brackets, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\*\*|\[\[|\]\]", ""), r"\s+", " "))


def tag(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "^#", "")


def human_label(key: Column) -> Column:
    spaced = F.translate(key, "-_", "  ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def topic_value(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def day_bucket(instant: Column) -> Column:
    """The first ten characters of an instant."""
    return F.substring(instant.cast("string"), 1, 10)


def retained_until(instant: Column, days: int, hours: int = 0) -> Column:
    return instant + F.make_interval(days=F.lit(days), hours=F.lit(hours))


def minute_floor(millis: Column) -> Column:
    return (F.floor(millis / 60_000) * 60_000).cast("long")


def expired(until: Column, now: Column) -> Column:
    """An expiry that has come; none never does."""
    return F.coalesce(until <= now, F.lit(False))


def nanos(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp")) * 1000


def clamp(n: Column, low: int, high: int, default: int | None = None) -> Column:
    """``n`` without its fraction, within bounds; null is the default, if there is one."""
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    out = F.when(n.isNotNull(), F.least(F.greatest(whole, F.lit(low)), F.lit(high)))
    return (out if default is None else F.coalesce(out, F.lit(default))).cast("long")


def bounded_limit(n: Column) -> Column:
    """A list limit: 1 to 1000, 100 unless given."""
    return clamp(n, 1, 1000, 100)


def hex_share(digest: Column) -> Column:
    """The last eight hex digits as a share of their range."""
    return F.conv(F.right(digest, F.lit(8)), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def masked(values: Column, keys: tuple[str, ...]) -> Column:
    """A map with the values of some keys masked."""
    return F.transform_values(values, lambda k, v: F.when(k.isin(*keys), F.lit("[redacted]")).otherwise(v))


def url_token(text: Column) -> Column:
    """Base64 in the alphabet of URLs, without padding."""
    return F.translate(F.rtrim(F.base64(text.cast("binary")), F.lit("=")), "+/", "-_")


def from_url_token(token: Column) -> Column:
    padded = F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4))))
    return F.unbase64(padded).cast("string")
