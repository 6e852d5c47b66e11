"""The nested responses of the four verdicts, field by field as clients read them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import iso, staged
from . import headers, trust


def meta(checked_at: Column, cached: Column) -> Column:
    """When the verdict was worked out, and whether it came from the cache."""
    return F.struct(iso(checked_at).alias("checkedAt"), F.lit(R.API_VERSION).alias("apiVersion"), F.lit(R.PAID_WITH).alias("paidWith"), cached.alias("cached"))


def tls(scored: DataFrame) -> Column:
    """Of a row of the certificate score that has no error."""
    return F.struct(
        "domain", "score", F.lit(100).alias("maxScore"), "tier",
        F.struct(F.col("chain_valid_score").alias("chainValid"), F.col("trusted_ca_score").alias("trustedCa"), F.col("not_expired_score").alias("notExpired"), F.col("strong_crypto_score").alias("strongCrypto"), F.col("modern_tls_score").alias("modernTls")).alias("breakdown"),
        "warnings",
        F.struct(
            F.col("subject_name").alias("subject"), F.col("issuer_name").alias("issuer"), F.col("valid_from_iso").alias("validFrom"), F.col("valid_to_iso").alias("validTo"), F.col("days_remaining").alias("daysRemaining"), "san",
            F.coalesce("fingerprint256", F.lit("")).alias("fingerprint256"), F.coalesce("serial_number", F.lit("")).alias("serialNumber"), F.col("is_self_signed").alias("isSelfSigned"),
        ).alias("certificate"),
        F.struct(F.col("chain_depth").alias("depth"), (F.coalesce("auth_error", F.lit("")) == "").alias("valid"), "trusted", F.col("root_ca").alias("rootCa")).alias("chain"),
        F.struct("protocol", "cipher", F.coalesce("authorized", F.lit(False)).alias("authorized"), F.nullif("auth_error", F.lit("")).alias("authError")).alias("connection"),
    )


def header_audit(audited: DataFrame) -> Column:
    """Of a row of the header audit with ``final_url``, ``hostname``, ``status`` and ``redirects``."""
    return F.struct(
        F.col("final_url").alias("url"), "hostname", "grade", "score", F.col("max_score").alias("maxScore"), F.struct(*[F.col(n) for n, _, _ in headers.ANALYSES]).alias("analysis"), "warnings",
        F.struct("status", "redirects").alias("response"),
    )


def crawl_policy(policy: DataFrame) -> Column:
    """Of a row of the crawl policy; ``summary`` and ``ai`` are null where there is no robots.txt."""
    summary = F.struct(F.size("groups").alias("userAgentGroups"), F.size("sitemaps").alias("sitemaps"), F.col("raw_lines").alias("rawLines"), "truncated", F.col("has_errors").alias("hasParseErrors"))
    ai = F.struct(F.col("global_block").alias("globalBlock"), F.col("global_allow").alias("globalAllow"), F.lit(len(R.BOTS)).alias("knownBotsChecked"), F.col("blocked").alias("knownBotsBlocked"), F.col("partial").alias("knownBotsPartial"), "policies")
    return F.struct(
        "domain", "exists", "tier", F.col("friendly").alias("aiFriendly"), F.when(F.col("exists"), summary).alias("summary"), F.when(F.col("exists"), ai).alias("ai"),
        "sitemaps", F.col("groups").alias("userAgents"), F.struct("status").alias("response"),
    )


KINDS = {"trust": ("domain", trust.verdict), "tls": ("domain", tls), "headers": ("url", header_audit), "robots": ("domain", crawl_policy)}


def body(kind: str, scored: DataFrame, checked_at: Column, cached: Column) -> DataFrame:
    """kind, key and the response as JSON text, nulls written; the verdict is finished in a stage before, so that generated code stays small."""
    key, nested = KINDS[kind]
    rows = staged(scored, {"_cached": cached, "_checked": checked_at})
    whole = nested(rows)
    rows = staged(rows.select(F.col(key).alias("key"), whole.alias("_body"), "_cached", "_checked"), {"_meta": meta(F.col("_checked"), F.col("_cached"))})
    names = rows.schema["_body"].dataType.names
    text = F.to_json(F.struct(*[F.col("_body")[n].alias(n) for n in names], F.col("_meta").alias("meta")), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("kind"), "key", text.alias("body"))


def health(now: Column) -> Column:
    """The answer of the health check."""
    return F.to_json(F.struct(F.lit("ok").alias("status"), iso(now).alias("timestamp")))


def service_document(name: str, base: str) -> str:
    """The answer of the root path: each paid path's price, parameter and an example, and links under ``base``."""
    ends = {}
    for path, price, _ in R.ENDPOINTS:
        parameter, example = ("url", "https://example.com") if path == "/headers" else ("domain", "example.com")
        ends[f"GET {path}"] = {"price": f"${price} USDC", "params": {parameter: "string"}, "example": f"{path}?{parameter}={example}"}
    return json.dumps({"name": name, "version": R.API_VERSION, "endpoints": ends, "links": {"api": base, "docs": f"{base}/openapi.json"}})


def openapi_document(name: str, base: str) -> str:
    """An OpenAPI 3.1 description of all paths: their parameter, and their answers by status."""
    answers = {"200": "Answer", "400": "Invalid input", "402": "Payment required", "429": "Too many requests", "502": "Check failed"}
    described = lambda codes: {c: {"description": answers[c]} for c in codes}
    paths = {path: {"get": {"operationId": path.strip("/").replace(".", "_") or "root", "responses": described(["200"])}} for path in R.FREE_PATHS}
    for path in R.PAID_PATHS:
        parameter = {"name": "url" if path == "/headers" else "domain", "in": "query", "required": True, "schema": {"type": "string"}}
        paths[path] = {"get": {"operationId": path.strip("/"), "parameters": [parameter], "responses": described(answers)}}
    return json.dumps({"openapi": "3.1.0", "info": {"title": name, "version": R.API_VERSION}, "servers": [{"url": base}], "paths": paths})


def free_answers(spark: SparkSession, name: str, base: str, now: Column) -> DataFrame:
    """path and body of the free paths' answers."""
    bodies = {"/": F.lit(service_document(name, base)), "/health": health(now), "/openapi.json": F.lit(openapi_document(name, base))}
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), b.alias("body")) for p, b in bodies.items()])).alias("r")).select("r.*")
