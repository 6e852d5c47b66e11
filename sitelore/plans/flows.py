"""Queries of traffic and decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..operators import decide as D
from ..operators import traffic as A
from . import verdicts
from .fixtures import ctes, view

_TTL, _WINDOW, _MOST, _ENTRIES = 14_400, 3_600, 2, 20


def _requests(spark, sf_dir):
    return view(spark, sf_dir, "requests")


def cache_misses(spark, sf_dir):
    return A.cache_trace(_requests(spark, sf_dir), "user_id", _TTL).groupBy("user_id").agg(F.count_if(~F.col("hit")).alias("misses"), F.count("*").alias("requests"))


def cache_hits(spark, sf_dir):
    """Each request with the time of the answer that it gets."""
    return A.cache_trace(_requests(spark, sf_dir), "user_id", _TTL).select("request_id", "hit", F.unix_micros("anchor").alias("checked_at_us"))


def cache_fifo(spark, sf_dir):
    """One cache for each endpoint, small enough to be full."""
    return A.fifo_trace(_requests(spark, sf_dir), "user_id", _TTL, most=_ENTRIES, cache="path")


def rate_limit(spark, sf_dir):
    return A.rate_limit(_requests(spark, sf_dir), "ip", _MOST, _WINDOW).groupBy("status").agg(F.count("*").alias("n"), F.sum("request_id").alias("ids"))


def request_log(spark, sf_dir):
    out = A.request_log(A.rate_limit(_requests(spark, sf_dir), "ip", _MOST, _WINDOW))
    return out.select("evt", "request_id", "path", "status", "settled", "ip", "ua", "duration_ms", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def route_status(spark, sf_dir):
    rows = A.rate_limit(_requests(spark, sf_dir), "ip", _MOST, _WINDOW).withColumn("limited", F.col("status") == 429).drop("status")
    rows = rows.withColumn("path", F.when(F.col("request_id") % 50 == 0, "/health").otherwise(F.col("path")))
    return A.route_status(rows).groupBy("path", "status").agg(F.count("*").alias("n"))


def payment_header(spark, sf_dir):
    rows = _requests(spark, sf_dir).where("not paid").withColumn("version", (F.col("request_id") % 3).cast("int"))
    body = F.concat(F.lit('{"x402Version":2,"resource":"'), F.col("path"), F.lit('","payer":"'), F.coalesce("ua", F.lit("")), F.lit('"}'))
    return rows.select("request_id", A.payment_header(F.lit(402), F.col("version"), F.col("request_id") % 7 == 0, body).alias("header"))


def probe_timeouts(spark, sf_dir):
    ms = F.col("duration_ms") * 4
    kept = [F.count(A.within(ms, p, F.lit(1))).alias(p) for p in R.TIMEOUTS]
    return _requests(spark, sf_dir).groupBy("path").agg(*kept)


def catalog(spark, sf_dir):
    return A.endpoints(spark).select("path", F.col("price").cast("string").alias("price"), "cache_seconds", "paid")


def _decided(spark, sf_dir):
    trust = verdicts.scored_trust(spark, sf_dir).select(F.regexp_extract("domain", "^d([0-9]+)", 1).cast("long").alias("k"), "domain", F.col("tier").alias("trust"))
    ssl = verdicts.scored_tls(spark, sf_dir).where("error is null").select("k", F.col("tier").alias("ssl"))
    return trust.join(ssl, "k", "left")


def decision_unknown_url(spark, sf_dir):
    return _decided(spark, sf_dir).select("domain", "trust", "ssl", D.unknown_url(F.col("trust"), F.col("ssl")).alias("decision"))


def decision_payment(spark, sf_dir):
    return _decided(spark, sf_dir).select("domain", D.payment(F.col("trust"), F.col("ssl")).alias("decision"))


def decision_crawl(spark, sf_dir):
    return verdicts.robots_tier(spark, sf_dir).select("domain", "tier", D.crawl(F.col("tier")).alias("decision"))


def decision_cost(spark, sf_dir):
    rows = verdicts.scored_trust(spark, sf_dir).select("tier", D.unknown_url_cost(F.col("tier")).alias("cost"))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.sum("cost").cast("double").alias("dollars"))


def status_action(spark, sf_dir):
    rows = A.route_status(A.rate_limit(_requests(spark, sf_dir), "ip", _MOST, _WINDOW).withColumn("limited", F.col("status") == 429).drop("status"))
    return rows.select("status").distinct().withColumn("action", D.status_action(F.col("status")))


QUERIES = {
    f.__name__: f
    for f in (cache_misses, cache_hits, cache_fifo, rate_limit, request_log, route_status, payment_header, probe_timeouts, catalog, decision_unknown_url, decision_payment, decision_crawl, decision_cost, status_action)
}

# A recursive walk from each key's first request to the next that misses.
_TRACE = f"""{ctes("requests")}, t AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM requests),
nexts AS (SELECT a.user_id, a.t, (SELECT min(b.t) FROM t b WHERE b.user_id = a.user_id AND b.t > a.t + {_TTL * 1_000_000}) AS n FROM t a),
walk(user_id, t) AS (SELECT user_id, min(t) FROM t GROUP BY user_id UNION ALL SELECT w.user_id, x.n FROM walk w JOIN nexts x ON x.user_id = w.user_id AND x.t = w.t WHERE x.n IS NOT NULL)"""
_LIMITED = f"""{ctes("requests")}, l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ip, epoch_us(ts) // {_WINDOW * 1_000_000} ORDER BY ts, request_id) <= {_MOST} THEN 200 ELSE 429 END AS passed FROM requests)"""
_PAID = ", ".join(f"'{p}'" for p in R.PAID_PATHS)
_ROUTE = f"CASE WHEN path IN ('/', '/health', '/openapi.json') THEN 200 WHEN path IN ({_PAID}) AND NOT paid THEN 402 WHEN passed = 429 THEN 429 WHEN path NOT IN ({_PAID}) THEN 404 WHEN NOT valid THEN 400 WHEN probe_failed THEN CASE WHEN path = '/trustscore' THEN 500 ELSE 502 END ELSE 200 END"
_TRUST, _TLS = verdicts.ORACLES["trust_score"], verdicts.ORACLES["tls_tier"]
_BOTH = f"WITH a AS ({_TRUST}), b AS ({_TLS}), j AS (SELECT a.domain, a.tier AS trust, b.tier AS ssl FROM a LEFT JOIN b ON split_part(a.domain, '.', 1) = split_part(b.domain, '.', 1))"

ORACLES = {
    "cache_misses": f"{_TRACE} SELECT user_id, (SELECT count(*) FROM walk w WHERE w.user_id = r.user_id) AS misses, count(*) AS requests FROM requests r GROUP BY user_id",
    "cache_hits": f"""{_TRACE}, a AS (SELECT r.request_id, r.user_id, epoch_us(r.ts) AS t, w.t AS a FROM requests r ASOF JOIN walk w ON r.user_id = w.user_id AND epoch_us(r.ts) >= w.t)
SELECT request_id, t > a OR request_id <> min(request_id) OVER (PARTITION BY user_id, t) AS hit, a AS checked_at_us FROM a""",
    # step by step: a cache's entries in their order of insertion, as a list
    "cache_fifo": f"""{ctes("requests")}, r AS (SELECT path, request_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY path ORDER BY ts, request_id) AS i FROM requests),
walk(path, i, request_id, k, hit, entries) AS (
  SELECT path, i, request_id, user_id, false, [{{'k': user_id, 'x': t + {_TTL * 1_000_000}}}] FROM r WHERE i = 1
  UNION ALL
  SELECT path, i, request_id, k, hit, CASE WHEN hit THEN entries WHEN len(others) = {_ENTRIES} THEN list_append(others[2:], {{'k': k, 'x': t + {_TTL * 1_000_000}}}) ELSE list_append(others, {{'k': k, 'x': t + {_TTL * 1_000_000}}}) END
  FROM (SELECT r.path, r.i, r.request_id, r.user_id AS k, r.t, w.entries, len(list_filter(w.entries, lambda e: e.k = r.user_id AND r.t <= e.x)) > 0 AS hit, list_filter(w.entries, lambda e: e.k <> r.user_id) AS others
    FROM walk w JOIN r ON r.path = w.path AND r.i = w.i + 1))
SELECT request_id, CAST(k AS VARCHAR) AS key, hit FROM walk""",
    "rate_limit": f"{_LIMITED} SELECT CAST(passed AS INTEGER) AS status, count(*) AS n, CAST(sum(request_id) AS BIGINT) AS ids FROM l GROUP BY passed",
    "request_log": f"{_LIMITED} SELECT 'request' AS evt, request_id, path, CAST(passed AS INTEGER) AS status, passed = 200 AS settled, ip, substr(ua, 1, 120) AS ua, duration_ms, epoch_us(ts) AS ts_us FROM l WHERE path IN ({_PAID})",
    "route_status": f"{_LIMITED}, p AS (SELECT * REPLACE (CASE WHEN request_id % 50 = 0 THEN '/health' ELSE path END AS path) FROM l) SELECT path, {_ROUTE} AS status, count(*) AS n FROM p GROUP BY 1, 2",
    "payment_header": f"""{ctes("requests")} SELECT request_id, CASE WHEN request_id % 3 = 2 AND request_id % 7 <> 0 THEN base64(encode('{{"x402Version":2,"resource":"' || path || '","payer":"' || coalesce(ua, '') || '"}}')) END AS header FROM requests WHERE NOT paid""",
    "probe_timeouts": f"{ctes('requests')} SELECT path, {', '.join(f'CAST(count_if(duration_ms * 4 <= {ms}) AS BIGINT) AS {p}' for p, ms in R.TIMEOUTS.items())} FROM requests GROUP BY path",
    "catalog": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {s}, true)" for p, c, s in R.ENDPOINTS) + ", " + ", ".join(f"('{p}', '0.000', 0, false)" for p in R.FREE_PATHS) + ") t(path, price, cache_seconds, paid)",
    "decision_unknown_url": f"{_BOTH} SELECT domain, trust, ssl, CASE WHEN trust = 'HIGH_RISK' OR trust = 'CAUTION' AND ssl IN ('INVALID', 'EXPIRED', 'UNTRUSTED') THEN 'refuse' ELSE 'proceed' END AS decision FROM j",
    "decision_payment": f"{_BOTH} SELECT domain, CASE WHEN trust IN ('TRUSTED', 'MODERATE') AND ssl = 'VALID' THEN 'proceed' ELSE 'refuse' END AS decision FROM j",
    "decision_crawl": f"WITH t AS ({verdicts.ORACLES['robots_tier']}) SELECT domain, tier, CASE tier WHEN 'BLOCKED_AI' THEN 'stop' WHEN 'BLOCKED_ALL' THEN 'stop' WHEN 'NO_ROBOTS_TXT' THEN 'proceed' ELSE 'proceed_with_rules' END AS decision FROM t",
    "decision_cost": f"WITH t AS ({_TRUST}) SELECT tier, count(*) AS n, CAST(count(*) * CASE WHEN tier = 'CAUTION' THEN 0.008 ELSE 0.003 END AS DOUBLE) AS dollars FROM t GROUP BY tier",
    "status_action": f"{_LIMITED}, s AS (SELECT DISTINCT {_ROUTE} AS status FROM l) SELECT status, CASE status WHEN 200 THEN 'use' WHEN 400 THEN 'do_not_retry' WHEN 402 THEN 'pay_and_retry' WHEN 429 THEN 'wait_and_retry' WHEN 500 THEN 'retry_once' WHEN 502 THEN 'treat_as_negative' ELSE 'unknown' END AS action FROM s",
}
