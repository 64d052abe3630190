"""Access: tiers reached by name, stubs in place of withheld rows, bucketed counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of the tiers (fixed values of the derived views).
TIER_RANK = {"open": 10, "restricted": 50, "sealed": 90}
STUB_PREFIX = "redaction_"


@dataclass(frozen=True)
class Grant:
    """What a reader may reach: tiers by name, and whose assertions it may supersede."""

    client_id: str
    tiers: tuple[str, ...] = ("open",)
    supersession_scope: str = "own"
    max_page: int = 200
    ceiling: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "ceiling", max((TIER_RANK[t] for t in self.tiers), default=0))


def allowed(grant: Grant, tier: Column, withheld: Column) -> Column:
    """A row is shown if it isn't withheld and its tier is granted by name."""
    return ~withheld & tier.isin(*grant.tiers)


def stub_id(grant: Grant, record_id: Column) -> Column:
    """An id that is stable for this reader and says nothing of the record."""
    return F.concat(F.lit(STUB_PREFIX), F.substring(F.sha2(F.concat(F.lit(grant.client_id), F.char(F.lit(0)), record_id), 256), 1, 32))


def disclosure(grant: Grant, rank: Column) -> Column:
    """``shape`` up to one rank above the reader's ceiling, else only the existence."""
    return F.when(rank - F.lit(grant.ceiling) <= 1, "shape").otherwise("existence-only")


def may_supersede(grant: Grant, author: Column) -> Column:
    return F.lit(True) if grant.supersession_scope == "any" else author == F.lit(grant.client_id)


def bucket_count(n: Column, width: int = 10) -> Column:
    """Counts rounded up to the bucket; zero stays zero."""
    return (F.ceil(n / width) * width).cast("long")
