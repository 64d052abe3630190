"""Units of meaning, titles and role hints of note text.

All but the evidence chunks are column expressions. A text is cut by turning what separates units
(blank lines, and the line break before a bullet, heading or property) into one mark and splitting
on it; words are looked up in tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 4096
#: Separates units; a control character that notes don't hold.
MARK = "\x1e"
#: How a line that opens a unit begins: bullet, heading or property.
OPENING = r"[-*+][ \t]+|#{1,6}[ \t]+|[A-Za-z][A-Za-z0-9_-]*::"
BLANK_LINES = r"\n([ \t\r]*\n)+"

#: What a property says by its key (fixed values: the published kinds depend on these words).
PROPERTY_KIND = {
    "source": "provenance",
    "org": "relationship", "organization": "relationship", "employer": "relationship", "role": "relationship", "relationship": "relationship", "manager": "relationship", "member": "relationship", "affiliation": "relationship",
    "phone": "fact", "email": "fact", "address": "fact", "birthday": "fact", "date": "fact", "website": "fact", "url": "fact", "location": "fact", "last-contacted": "fact", "full-name": "fact", "alias": "fact", "also-known-as": "fact",
}
#: What a labelled bullet says by a word of its label, first kind first (fixed values).
LABEL_KIND = (
    ("relationship", ("relationship", "role", "member", "friend", "family", "work at", "works at", "work with", "works with", "report to", "reports to")),
    ("provenance", ("source", "evidence", "confirmed", "verified")),
    ("fact", ("phone", "email", "address", "birthday", "date", "website", "url", "location")),
)
#: Labels of bullets that only arrange the page (fixed values).
ARRANGING = ("context", "contact", "note", "notes", "detail", "details", "source", "sources", "reference", "references")
#: Phrases of an editor's remark in brackets, not of the subject (fixed values).
REMARKS = ("initial stub", "migration note", "migration pass", "enrichment pass", "no web enrichment performed", "no web research performed")

#: Roles by the words of a hint: (predicate, role, whole words, beginnings of words); an earlier line wins (fixed values).
ROLES = (
    ("member-of", "board-member", ("board", "trustee"), ()),
    ("founder-of", None, ("founding",), ("founder", "cofounder")),
    ("member-of", "advisor", (), ("advisor", "advises", "advisory")),
    ("employed-by", None, (
        "day job", "dayjob", "employee", "employed", "career", "work", "works", "staff", "cpo", "ceo", "coo", "cto", "cfo", "cro", "cmo", "cio", "svp", "evp", "vp", "director",
        "engineer", "manager", "president", "head of", "chief", "principal", "analyst", "associate", "sales", "operations"), ()),
    ("member-of", None, ("member", "chapter", "sorority", "fraternity"), ("alumn",)),
)


def segments(text: Column) -> Column:
    """Units of meaning, in order: a bullet, heading, property or paragraph with the lines folded into it."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), BLANK_LINES, MARK)
    marked = F.regexp_replace(marked, rf"\n[ \t]*({OPENING})", MARK + "$1")
    folded = F.regexp_replace(marked, r"[ \t]*\n[ \t]*", " ")
    return F.filter(F.transform(F.split(folded, MARK), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")


def key_of(unit: Column) -> Column:
    return F.lower(F.regexp_extract(unit, r"^([A-Za-z][A-Za-z0-9_-]*)::", 1))


def label_of(unit: Column) -> Column:
    """The label of ``- **Label:** text`` or ``- Label: text``, lower-cased."""
    return F.lower(F.regexp_extract(unit, r"^[-*+][ \t]+(?:\*\*)?([A-Za-z][A-Za-z /&-]{0,48}):", 1))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def segment_kind(unit: Column) -> Column:
    """Kind of a unit: by its property key, as a heading, by its label, else an observation."""
    label, key = label_of(unit), key_of(unit)
    out = F.when(key != "", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in PROPERTY_KIND.items() for x in pair)), key), F.lit("attribute")))
    out = out.when(unit.rlike(r"^#{1,6}[ \t]+[^ \t]"), "entity")
    for kind, words in LABEL_KIND:
        out = out.when(any_of(label, words), kind)
    return out.otherwise("observation")


def exclusion(unit: Column) -> Column:
    """Why a unit is left out of the meaning, or null: it arranges the page, instructs the source system, or is a remark."""
    heading = F.lower(F.regexp_extract(unit, r"^[-*+][ \t]+\*\*([^*]+)\*\*[ \t]*$", 1))
    plain = F.regexp_replace(F.trim(heading), r"[:.]$", "")
    low = F.lower(unit)
    instructs = low.rlike(r"^type::[ \t]*query$") | F.contains(low, F.lit("{{query")) | low.rlike(r"(^|[^a-z0-9_])grep[ \t]+-[a-z]*n[a-z]*([^a-z0-9_]|$)") | F.contains(low, F.lit("pages/*.md"))
    bracketed = F.regexp_extract(low, r"^(?:[-*+][ \t]+)?\(([^()]*)\)$", 1)
    return (
        F.when((heading != "") & (plain.isin(*ARRANGING) | plain.rlike(r"^relationship to \[\[[^\]]+\]\]$")), "source organization")
        .when(instructs, "source-system instruction").when(any_of(bracketed, REMARKS), "editorial migration commentary")
    )


def title_units(title: Column) -> Column:
    """(name, note) of each part of a title between middle dots outside brackets.

    The pieces between all dots are folded from the left: while a bracket is open, a piece
    belongs to the one before. A part's note is what its first round bracket holds.
    """
    times = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    opened = lambda x: times(x, "(") + times(x, "[") - times(x, ")") - times(x, "]")

    def fold(acc, piece):
        inside, last = acc["depth"] > 0, F.size(acc["parts"])
        joined = F.concat(F.element_at(acc["parts"], -1), F.lit("·"), piece)
        parts = F.when(inside, F.concat(F.slice(acc["parts"], F.lit(1), last - 1), F.array(joined))).otherwise(F.concat(acc["parts"], F.array(piece)))
        return F.struct(parts.alias("parts"), F.greatest(F.lit(0), acc["depth"] + opened(piece)).alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("depth"))
    parts = F.aggregate(F.split(F.coalesce(title, F.lit("")), "·"), start, fold, lambda acc: acc["parts"])

    def unit(part):
        part = F.trim(part)
        at = F.locate("(", part)
        head = F.trim(F.when(at > 1, F.substring_index(part, "(", 1)).otherwise(part))
        note = F.when(at > 1, F.regexp_replace(F.substring(part, at + 1, F.length(part)), r"[ \t)]+$", ""))
        return F.struct(F.trim(F.regexp_replace(head, r"\[\[|\]\]", "")).alias("name"), F.when(F.trim(note) != "", F.trim(note)).alias("note"))

    return F.filter(F.transform(parts, unit), lambda u: u["name"] != "")


def affiliation(hint: Column) -> Column:
    """(predicate, role, confidence) that the words of a role hint suggest; without a known word it needs review."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(hint, F.lit(""))), r"[^a-z0-9]+", " ")), F.lit(" "))
    answer = lambda p, r, c: F.struct(F.lit(p).cast("string").alias("predicate"), F.lit(r).cast("string").alias("role"), F.lit(c).alias("confidence"))
    out = None
    for predicate, role, whole, begin in ROLES:
        hit = any_of(words, (*(f" {w} " for w in whole), *(f" {b}" for b in begin)))
        value = answer(predicate, role, "high")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(answer(None, None, "needs-review"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence_chunks(text: pd.Series) -> pd.Series:
    """Chunks of at most ``CHUNK`` characters, broken after the last newline where there is one."""

    def cut(rest: str | None) -> list[str]:
        out = []
        while rest:
            piece = rest[:CHUNK]
            if len(rest) > CHUNK and "\n" in piece:
                piece = piece[: piece.rindex("\n") + 1]
            out.append(piece)
            rest = rest[len(piece) :]
        return out

    return text.map(cut)
