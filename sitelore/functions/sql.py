"""The verdict rules as SQL functions and views of a session.

Scalar functions are SQL text that the optimizer inlines; nothing crosses into
Python.  ``register`` makes them, and the views ``endpoints`` and ``known_bots``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import refdata as R
from ..operators import traffic

_Q = lambda xs: ", ".join("'" + x.replace("'", "\\'") + "'" for x in xs)
_ANY = lambda c, xs: "(" + " OR ".join(f"contains({c}, {_Q([x])})" for x in xs) + ")"

#: Name, parameters, type, body.
FUNCTIONS = (
    ("js_or", "a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),
    ("tld_of", "domain STRING", "STRING", "concat('.', lower(split_part(domain, '.', -1)))"),
    ("tld_points", "domain STRING", "INT", f"CASE WHEN tld_of(domain) IN ({_Q(R.TRUSTED_TLDS)}) THEN 20 WHEN tld_of(domain) IN ({_Q(R.RISKY_TLDS)}) THEN 0 ELSE 10 END"),
    ("age_points", "days INT", "INT", "CASE WHEN days IS NULL THEN 0 WHEN days > 1825 THEN 30 WHEN days > 730 THEN 25 WHEN days > 365 THEN 18 WHEN days > 90 THEN 10 ELSE 2 END"),
    ("dns_points", "has_a BOOLEAN, has_mx BOOLEAN", "INT", "CASE WHEN has_a THEN 20 ELSE 0 END + CASE WHEN has_mx THEN 10 ELSE 0 END"),
    ("registrar_points", "registrar STRING", "INT", f"CASE WHEN {_ANY('lower(registrar)', R.REGISTRARS)} THEN 20 ELSE 10 END"),
    ("trust_points", "domain STRING, days INT, has_a BOOLEAN, has_mx BOOLEAN, registrar STRING", "INT", "age_points(days) + tld_points(domain) + dns_points(has_a, has_mx) + registrar_points(registrar)"),
    ("trust_tier", "score INT", "STRING", "CASE WHEN score >= 75 THEN 'TRUSTED' WHEN score >= 50 THEN 'MODERATE' WHEN score >= 25 THEN 'CAUTION' ELSE 'HIGH_RISK' END"),
    ("is_weak_cipher", "name STRING", "BOOLEAN", _ANY("lower(name)", R.WEAK_CIPHERS)),
    ("is_known_ca", "name STRING", "BOOLEAN", _ANY("lower(name)", R.AUTHORITIES)),
    ("header_grade", "score INT", "STRING", "CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END"),
    ("is_private_address", "addr STRING", "BOOLEAN", f"addr RLIKE r'{R.PRIVATE_V4_WIDE}' OR lower(addr) RLIKE r'{R.PRIVATE_V6}'"),
    ("base64_line", "text STRING", "STRING", "translate(base64(encode(text, 'utf-8')), '\\r\\n', '')"),
)

#: Table functions, one for each verdict: used with LATERAL, they inline as well.
TABLE_FUNCTIONS = (
    ("trust_verdict", "domain STRING, days INT, has_a BOOLEAN, has_mx BOOLEAN, registrar STRING", "age INT, tld INT, dns INT, registrar_score INT, score INT, tier STRING",
     "SELECT age_points(days), tld_points(domain), dns_points(has_a, has_mx), registrar_points(registrar), trust_points(domain, days, has_a, has_mx, registrar), trust_tier(trust_points(domain, days, has_a, has_mx, registrar))"),
    ("tls_verdict", "days INT, self_signed BOOLEAN, auth_error STRING, trusted BOOLEAN, score INT", "tier STRING",
     "SELECT CASE WHEN days < 0 THEN 'EXPIRED' WHEN self_signed THEN 'UNTRUSTED' WHEN coalesce(auth_error, '') <> '' THEN 'INVALID' WHEN NOT trusted THEN 'UNTRUSTED' WHEN days < 7 THEN 'EXPIRING' WHEN score < 70 THEN 'WEAK' ELSE 'VALID' END"),
    ("header_verdict", "score INT", "grade STRING", "SELECT header_grade(score)"),
    ("crawl_verdict", "robots_exists BOOLEAN, global_block BOOLEAN, blocked INT, partial INT", "tier STRING",
     f"SELECT CASE WHEN NOT robots_exists THEN 'NO_ROBOTS_TXT' WHEN global_block AND blocked = {len(R.BOTS)} THEN 'BLOCKED_ALL' WHEN blocked > {len(R.BOTS) // 2} THEN 'BLOCKED_AI' WHEN blocked > 0 OR partial > {len(R.BOTS) // 3} THEN 'SELECTIVE' ELSE 'OPEN' END"),
)


def register(spark: SparkSession) -> None:
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    traffic.endpoints(spark).createOrReplaceTempView("endpoints")
    spark.createDataFrame([(i, b) for i, b in enumerate(R.BOTS)], "place int, bot string").createOrReplaceTempView("known_bots")
