"""Decisions that combine verdicts, their cost, and what a client does with a status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata as R

PRICE = {path: price for path, price, _ in R.ENDPOINTS}


def unknown_url(trust: Column, ssl: Column) -> Column:
    """Refuse at high risk; at caution refuse too if the certificate fails; else proceed."""
    return F.when(trust == "HIGH_RISK", "refuse").when((trust == "CAUTION") & ssl.isin("INVALID", "EXPIRED", "UNTRUSTED"), "refuse").otherwise("proceed")


def crawl(robots: Column) -> Column:
    return F.when(robots.isin("BLOCKED_AI", "BLOCKED_ALL"), "stop").when(robots == "NO_ROBOTS_TXT", "proceed").otherwise("proceed_with_rules")


def payment(trust: Column, ssl: Column) -> Column:
    return F.when(trust.isin("TRUSTED", "MODERATE") & (ssl == "VALID"), "proceed").otherwise("refuse")


def unknown_url_cost(trust: Column) -> Column:
    """Caution also buys the certificate check and the header audit; cached answers cost the same."""
    first = F.lit(PRICE["/trustscore"]).cast("decimal(6,3)")
    more = (F.lit(PRICE["/sslcheck"]).cast("decimal(6,3)") + F.lit(PRICE["/headers"]).cast("decimal(6,3)")).cast("decimal(6,3)")
    return F.when(trust == "CAUTION", (first + more).cast("decimal(6,3)")).otherwise(first)


def status_action(status: Column) -> Column:
    return (
        F.when(status == 200, "use").when(status == 400, "do_not_retry").when(status == 402, "pay_and_retry").when(status == 429, "wait_and_retry")
        .when(status == 500, "retry_once").when(status == 502, "treat_as_negative").otherwise("unknown")
    )
