"""Access policy: an ordered decision over a request, its capability and an object.

The decision is a table of rules per profile, not a program: ``RULES`` lists for each profile which
operations it may ask, which access classes it may read, and the reasons of a refusal. One
expression walks the general checks and then the profile's row; the first that applies decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

READ = ("object_get", "object_list", "search", "traverse", "timeline")
WRITE = ("create", "update", "tombstone")
SYNC = ("sync_push", "sync_pull", "sync_status")
ADMIN = ("policy_change", "key_rotate", "audit_read")
REMOTE_CLASSES = ("remote-safe", "shareable", "release")
ALL_CLASSES = (*REMOTE_CLASSES, "local-private", "quarantine")


@dataclass(frozen=True)
class Rule:
    """What a profile may do, what a refusal of either kind is called, and how it is shown."""

    operations: tuple[str, ...]
    classes: tuple[str, ...]
    operation_reason: str = "profile-operation-denied"
    class_reason: str = "remote-sensitive-unavailable"
    shown: str = "redacted-audit"
    ciphertext: bool = False
    plaintext: bool = True


RULES = {
    "sync-device": Rule(SYNC, ALL_CLASSES, "sync-plaintext-denied", shown="generic-unavailable", ciphertext=True, plaintext=False),
    "remote-safe": Rule(READ, REMOTE_CLASSES, shown="generic-unavailable"),
    "remote-cloud-unlock": Rule(READ, ALL_CLASSES, "cloud-unlock-mutation-denied", "cloud-unlock-required", "generic-unavailable"),
    "local-readonly": Rule(READ, ALL_CLASSES, "readonly-denied"),
    "local-full": Rule((*READ, *WRITE), ALL_CLASSES),
    "local-crud": Rule((*READ, *WRITE), ALL_CLASSES),
    "sensitive-keyholding-client": Rule((*READ, *WRITE), ALL_CLASSES),
    "local-release": Rule((*READ, *WRITE), REMOTE_CLASSES),
    "local-admin": Rule((*READ, *WRITE, *ADMIN), ALL_CLASSES),
}
ALLOWED = "allowed"


def capability_reason(now: Column) -> Column:
    """Why a capability does not cover the request, or null.

    Columns: actor, profile, operation, access_mode of the request; cap_client (null: no
    capability), cap_revoked_at, cap_expires_at, cap_profile, cap_access_mode, cap_operations,
    cap_classes; access_class of the object.
    """
    c = F.col
    checks = (
        (c("cap_client").isNull(), "missing-capability"), (c("cap_client") != c("actor"), "capability-actor-mismatch"), (c("cap_revoked_at").isNotNull(), "capability-revoked"),
        (c("cap_expires_at") <= now, "capability-expired"), (c("cap_profile") != c("profile"), "capability-profile-mismatch"), (c("cap_access_mode") != c("access_mode"), "capability-profile-mismatch"),
        (~F.array_contains("cap_operations", c("operation")), "capability-operation-denied"), (~F.array_contains("cap_classes", c("access_class")), "capability-access-class-denied"),
    )
    return F.coalesce(*(F.when(test, reason) for test, reason in checks))


def object_reason(now: Column) -> Column:
    """Why the profile may not ask this of this object, or null. Further columns: release_expires_at, unlocked."""
    c = F.col
    past_sync = c("profile") != "sync-device"
    reasons = [
        F.when(past_sync & (c("access_class") == "quarantine") & (c("profile") != "local-admin"), "quarantine-denied"),
        F.when(past_sync & (c("access_class") == "release") & (c("release_expires_at") <= now), "release-expired"),
        F.when(~c("profile").isin(*RULES), "profile-operation-denied"),
    ]
    for profile, rule in RULES.items():
        mine = c("profile") == profile
        reasons.append(F.when(mine & ~c("operation").isin(*rule.operations), rule.operation_reason))
        if profile == "remote-cloud-unlock":  # what is not open to all needs an unlocked session
            session = (c("access_mode") == "cloud-unlock-session") & c("unlocked")
            reasons.append(F.when(mine & ~c("access_class").isin(*REMOTE_CLASSES) & ~session, rule.class_reason))
        else:
            reasons.append(F.when(mine & ~c("access_class").isin(*rule.classes), rule.class_reason))
    return F.coalesce(*reasons)


def evaluate(now: Column) -> Column:
    """(reason, allowed, shown, plaintext, ciphertext) of each row: the capability's checks, then the object's."""
    reason = F.coalesce(capability_reason(now), object_reason(now), F.lit(ALLOWED))
    ok = reason == ALLOWED
    of = lambda value: F.coalesce(*(F.when(F.col("profile") == p, F.lit(value(r))) for p, r in RULES.items()), F.lit(value(Rule((), (), shown="generic-unavailable"))))
    plain = of(lambda r: r.plaintext) & (~F.col("profile").isin("remote-safe") | (F.col("payload") == "plaintext-json"))
    shown = F.when(F.startswith(reason, F.lit("capability")) | (reason == "missing-capability"), "generic-unavailable").otherwise(of(lambda r: r.shown))
    return F.struct(reason.alias("reason"), ok.alias("allowed"), F.when(~ok, shown).alias("shown"), (ok & plain).alias("plaintext"), (ok & of(lambda r: r.ciphertext)).alias("ciphertext"))
