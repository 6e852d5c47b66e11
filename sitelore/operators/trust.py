"""Domain trust score from registration, DNS, top-level domain and registrar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import col, contains_any, elapsed_days, first_text, staged, to_time

#: Keys of a registration record that a verdict reads.
CREATED_KEYS, REGISTRAR_KEYS = ("creationDate", "created", "domainRegistered"), ("registrar", "registrarName")


def _key(whois: Column, *names: str) -> Column:
    return first_text(*[F.try_element_at(whois, F.lit(n)) for n in names])


def age_score(created: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(days, score, label); days -1 where the date is unknown."""
    return age_points(elapsed_days(as_of, created))


def age_points(days: Column) -> tuple[Column, Column, Column]:
    steps = ((1825, 30, "established (5+ years)"), (730, 25, "mature (2–5 years)"), (365, 18, "growing (1–2 years)"), (90, 10, "new (90d–1yr)"))
    score, label = F.when(days.isNull(), 0), F.when(days.isNull(), "unknown")
    for least, points, name in steps:
        score, label = score.when(days > least, points), label.when(days > least, name)
    return F.coalesce(days, F.lit(-1)), score.otherwise(2).cast("int"), label.otherwise("very new (<90 days)")


def top_level(domain: Column) -> Column:
    """The last label with its dot."""
    return F.concat(F.lit("."), F.lower(F.split_part(domain, F.lit("."), F.lit(-1))))


def tld_points_of(tld: Column) -> Column:
    return F.when(tld.isin(*R.TRUSTED_TLDS), 20).when(tld.isin(*R.RISKY_TLDS), 0).otherwise(10).cast("int")


def tld_score(domain: Column | str) -> tuple[Column, Column]:
    """(label with its dot, score)."""
    tld = top_level(col(domain))
    return tld, tld_points_of(tld)


def dns_score(has_a: Column, mx: Column) -> tuple[Column, Column, Column]:
    """(score, has MX, the first three exchanges in the resolver's order)."""
    has_mx = F.coalesce(F.size(mx) > 0, F.lit(False))
    score = F.when(has_a, 20).otherwise(0) + F.when(has_mx, 10).otherwise(0)
    return score.cast("int"), has_mx, F.slice(F.coalesce(mx, F.array().cast("array<string>")), 1, 3)


def registrar_score(registrar: Column) -> tuple[Column, Column]:
    """(name shown, score); an unknown registrar scores as an unlisted one."""
    return F.coalesce(first_text(registrar), F.lit("unknown")), registrar_points_of(F.lower(registrar))


def registrar_points_of(low: Column) -> Column:
    return F.when(contains_any(low, R.REGISTRARS), 20).otherwise(10).cast("int")


def tier(score: Column) -> Column:
    return F.when(score >= 75, "TRUSTED").when(score >= 50, "MODERATE").when(score >= 25, "CAUTION").otherwise("HIGH_RISK")


def trust_score(inputs: DataFrame, whois: DataFrame, dns: DataFrame, as_of: Column) -> DataFrame:
    """A row per domain of ``inputs(domain)``.

    ``whois(domain, whois MAP)`` and ``dns(domain, has_a, mx)`` are left-joined:
    a probe that failed is a missing row.
    """
    found = inputs.select("domain").distinct().join(whois.select("domain", "whois"), "domain", "left").join(dns.select("domain", "has_a", "mx"), "domain", "left")
    found = staged(found, {"_created": to_time(_key(F.col("whois"), *CREATED_KEYS)), "_registrar": _key(F.col("whois"), *REGISTRAR_KEYS), "_tld": top_level(F.col("domain"))})
    found = staged(found, {"_days": elapsed_days(as_of, F.col("_created")), "_low": F.lower("_registrar")})
    days, age, label = age_points(F.col("_days"))
    tld, tld_points = F.col("_tld"), tld_points_of(F.col("_tld"))
    dns_points, has_mx, mx = dns_score(F.coalesce("has_a", F.lit(False)), F.col("mx"))
    registrar, registrar_points = F.coalesce(first_text("_registrar"), F.lit("unknown")), registrar_points_of(F.col("_low"))
    out = found.select(
        "domain", days.alias("age_days"), label.alias("age_label"), age.alias("age_score"), tld.alias("tld"), tld_points.alias("tld_score"),
        F.coalesce("has_a", F.lit(False)).alias("has_a"), has_mx.alias("has_mx"), mx.alias("mx_records"), dns_points.alias("dns_score"),
        registrar.alias("registrar"), registrar_points.alias("registrar_score"), _key(F.col("whois"), "creationDate").alias("created"), _key(F.col("whois"), "expirationDate").alias("expires"),
    )
    out = out.withColumn("score", (F.col("age_score") + F.col("tld_score") + F.col("dns_score") + F.col("registrar_score")).cast("int"))
    return out.withColumn("tier", tier(F.col("score")))


def verdict(scored: DataFrame) -> Column:
    """The nested response of a row of ``trust_score``."""
    return F.struct(
        "domain", "score", F.lit(100).alias("maxScore"), "tier",
        F.struct(F.col("age_score").alias("domainAge"), F.col("tld_score").alias("tld"), F.col("dns_score").alias("dnsPresence"), F.col("registrar_score").alias("registrar")).alias("breakdown"),
        F.struct(
            F.struct(F.col("age_days").alias("days"), F.col("age_label").alias("label"), "created", "expires").alias("age"), "tld",
            F.struct(F.col("has_a").alias("hasARecord"), F.col("has_mx").alias("hasMxRecord"), F.col("mx_records").alias("mxRecords")).alias("dns"), "registrar",
        ).alias("details"),
    )
