"""Certificate score: chain, authority, validity, cipher and protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import contains_any, elapsed_days, empty, first_text, iso, notes, staged, to_time
from ..scratch import release, written

_COMPONENTS = ("chain_valid", "trusted_ca", "not_expired", "strong_crypto", "modern_tls")


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def self_signed(subject: Column, issuer: Column) -> Column:
    """Name and organisation of subject and issuer equal; a missing one is empty, so a certificate without any is self-signed."""
    return (_text(subject["CN"]) == _text(issuer["CN"])) & (_text(subject["O"]) == _text(issuer["O"]))


def root_ca(root: Column) -> Column:
    return first_text(root["O"], root["CN"])


def known_ca(root: Column, issuer: Column) -> Column:
    return contains_any(_text(F.lower(root_ca(root))), R.AUTHORITIES) | contains_any(_text(F.lower(issuer["O"])), R.AUTHORITIES)


def san_list(text: Column, most: int = 20) -> Column:
    """The first names, without blanks and the ``DNS:`` mark; other marks stay."""
    parts = F.transform(F.split(_text(text), ","), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^(?i)DNS:", ""))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def weak_cipher(name: Column) -> Column:
    return contains_any(F.lower(name), R.WEAK_CIPHERS)


def components(authorized: Column, auth_error: Column, is_self_signed: Column, trusted: Column, days: Column, cipher: Column, protocol: Column) -> dict[str, tuple[Column, list[Column]]]:
    """Points and warnings by component, in the warnings' order."""
    valid = empty(auth_error)
    weak = weak_cipher(cipher)
    none = F.lit(None).cast("string")
    return {
        "chain_valid": (
            F.when(valid & authorized, 30).when(valid, 15).otherwise(0),
            [F.when(valid & authorized, none).when(valid, "chain_warning").otherwise("invalid_chain"), F.when(~valid, F.concat(F.lit("auth_error:"), auth_error))],
        ),
        "trusted_ca": (F.when(is_self_signed, 0).when(trusted, 25).otherwise(5), [F.when(is_self_signed, "self_signed").when(~trusted, "untrusted_ca")]),
        "not_expired": (
            F.when(days.isNull() | (days < 0), 0).when(days < 7, 5).when(days < 30, 15).otherwise(25),
            [F.when(days.isNull(), "unparseable_validity").when(days < 0, "expired").when(days < 7, "expires_within_7_days").when(days < 30, "expires_within_30_days")],
        ),
        "strong_crypto": (F.when(cipher.isNull() | weak, 0).otherwise(10), [F.when(weak, "weak_cipher")]),
        "modern_tls": (
            F.when(protocol == "TLSv1.3", 10).when(protocol == "TLSv1.2", 7).when(~empty(protocol), 2).otherwise(0),
            [F.when(~empty(protocol) & ~protocol.isin("TLSv1.3", "TLSv1.2"), "deprecated_tls")],
        ),
    }


def tier(days: Column, is_self_signed: Column, auth_error: Column, trusted: Column, total: Column) -> Column:
    return (
        F.when(days < 0, "EXPIRED").when(is_self_signed, "UNTRUSTED").when(~empty(auth_error), "INVALID").when(~trusted, "UNTRUSTED")
        .when(days < 7, "EXPIRING").when(total < 70, "WEAK").otherwise("VALID")
    )


def score(observed: DataFrame, as_of: Column) -> DataFrame:
    """``observed(domain, subject, issuer, root, valid_from, valid_to, subjectaltname, authorized, auth_error, protocol, cipher, ...)`` with facts, points, total, tier and warnings.

    A row without a certificate (null subject, issuer and root) has ``error`` set
    and no score.
    """
    kinds = dict(observed.dtypes)
    observed = staged(observed, {f"_{n}": to_time(F.col(n)) if kinds[n] == "string" else F.col(n) for n in ("valid_to", "valid_from")})
    until, since = F.col("_valid_to"), F.col("_valid_from")
    own = self_signed(F.col("subject"), F.col("issuer"))
    present = F.col("subject").isNotNull() | F.col("issuer").isNotNull() | F.col("root").isNotNull()
    facts = observed.withColumns({
        "error": F.when(~present, "No certificate presented"), "is_self_signed": own, "trusted": known_ca(F.col("root"), F.col("issuer")) & ~own, "days_remaining": elapsed_days(until, as_of),
        "subject_name": F.coalesce(first_text(F.col("subject")["CN"], F.col("subject")["O"]), F.col("domain")), "issuer_name": F.coalesce(first_text(F.col("issuer")["O"], F.col("issuer")["CN"]), F.lit("unknown")),
        "root_ca": root_ca(F.col("root")), "san": san_list(F.col("subjectaltname")), "valid_from_iso": iso(since), "valid_to_iso": iso(until),
    })
    facts = facts.drop("_valid_to", "_valid_from")
    parts = components(F.coalesce("authorized", F.lit(False)), F.col("auth_error"), F.col("is_self_signed"), F.col("trusted"), F.col("days_remaining"), F.col("cipher")["name"], F.col("protocol"))
    out = facts.withColumns({f"{n}_score": parts[n][0].cast("int") for n in _COMPONENTS})
    out = out.withColumn("warnings", notes(*[w for n in _COMPONENTS for w in parts[n][1]]))
    out = out.withColumn("score", sum((F.col(f"{n}_score") for n in _COMPONENTS), F.lit(0)).cast("int"))
    return out.withColumn("tier", tier(F.col("days_remaining"), F.col("is_self_signed"), F.col("auth_error"), F.col("trusted"), F.col("score")))


def walk_chains(edges: DataFrame, leaves: DataFrame, levels: int = 6) -> DataFrame:
    """``edges(fingerprint, issuer_fingerprint)``: leaf, depth and last certificate of each chain; a certificate met again ends it.

    Chains go up ``levels`` certificates in one plan; while any goes on, what is
    reached is written to the shared folder and goes up again.  So neither the
    number of chains nor their length has a bound.  Walks that have ended are
    spread by their leaves.
    """
    up = edges.select(F.col("fingerprint").alias("_key"), F.col("issuer_fingerprint").alias("_next")).where("_key is not null and _next is not null").distinct()
    walk = leaves.select(F.col("fingerprint").alias("leaf")).where("leaf is not null").distinct().select("leaf", F.col("leaf").alias("cur"), F.array("leaf").alias("seen"), F.lit(True).alias("going"))
    before = None
    while True:
        for _ in range(levels):
            keyed = walk.withColumn("_key", F.when(F.col("going"), F.col("cur")).otherwise(F.concat(F.lit("\0"), F.col("leaf"))))
            walk = keyed.join(up, "_key", "left").withColumn("going", F.coalesce(~F.array_contains("seen", F.col("_next")), F.lit(False)))
            walk = walk.select("leaf", F.when(F.col("going"), F.col("_next")).otherwise(F.col("cur")).alias("cur"), F.when(F.col("going"), F.array_append("seen", F.col("_next"))).otherwise(F.col("seen")).alias("seen"), "going")
        walk = written(walk, "chains")
        release(before)
        if walk.where("going").isEmpty():
            break
        before = walk
    return walk.groupBy("leaf").agg(F.max(F.struct(F.size("seen").alias("depth"), "cur")).alias("end")).select("leaf", "end.depth", F.col("end.cur").alias("last"))
