"""Queries over requests' inputs: choice, guards, hosts, ports, addresses; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..operators import normalize as N
from .fixtures import ctes, view

_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)

# What the oracles share: scheme, host and port of a raw input.
_URL = "CASE WHEN regexp_matches(raw, '^https?://', 'i') THEN raw ELSE 'https://' || raw END"
_HOST = r"lower(regexp_extract({u}, '^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1, 'i'))"
_PORT_TEXT = r"regexp_extract({u}, '^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(?::([^/?#]*))?', 1, 'i')"


def _port(u: str) -> str:
    t = _PORT_TEXT.format(u=u)
    n = f"TRY_CAST({t} AS INTEGER)"
    return f"CASE WHEN {t} = '' OR {n} = CASE WHEN regexp_matches({u}, '^https:', 'i') THEN 443 ELSE 80 END THEN '' WHEN regexp_matches({t}, '^[0-9]{{1,6}}$') AND {n} BETWEEN 0 AND 65535 THEN CAST({n} AS VARCHAR) END"


_PARTS = f", u AS (SELECT input_id, raw, {_URL} AS url FROM inputs), p AS (SELECT *, {_HOST.format(u='url')} AS host, {_port('url')} AS port FROM u)"
_PRIVATE = f"(regexp_matches({{h}}, '{R.PRIVATE_V4_WIDE}') OR regexp_matches(lower({{h}}), '{R.PRIVATE_V6}'))"


def _good_inputs(spark, sf_dir):
    return view(spark, sf_dir, "inputs").where("raw is not null")


def param_pick(spark, sf_dir):
    """Trust, certificate and robots prefer ``domain``, headers prefer ``url``."""
    rows = view(spark, sf_dir, "inputs").withColumn("url", F.when(F.col("input_id") % 3 != 0, F.concat(F.lit("https://u"), F.col("input_id").cast("string"))))
    return rows.select("input_id", N.pick("raw", "url").alias("for_domain"), N.pick("url", "raw").alias("for_headers"))


def input_errors(spark, sf_dir):
    domain, url = N.input_error(F.col("raw"), 253, "Domain"), N.input_error(F.col("raw"), 2048, "URL")
    parsed = F.col("error")
    return N.validate_url(view(spark, sf_dir, "inputs")).select(
        "input_id", domain["error"].alias("domain_error"), domain["message"].alias("domain_message"),
        F.when(url.isNotNull(), url["error"]).when(parsed.isNotNull(), "Invalid URL").alias("url_error"), F.when(url.isNotNull(), url["message"]).otherwise(parsed).alias("url_message"),
    ).where("domain_error is not null or url_error is not null")


def extract_domain(spark, sf_dir):
    return N.extract_domain(view(spark, sf_dir, "inputs")).select("input_id", "raw", "domain")


def validate_url(spark, sf_dir):
    return N.validate_url(_good_inputs(spark, sf_dir)).select("input_id", "raw", "host", "error")


def validate_robots_domain(spark, sf_dir):
    return N.validate_robots_domain(_good_inputs(spark, sf_dir)).select("input_id", "raw", "domain", "error")


def private_ip(spark, sf_dir):
    rows = view(spark, sf_dir, "addresses").select("addr").where("addr is not null").unionByName(view(spark, sf_dir, "inputs").select(F.col("raw").alias("addr")).where("addr is not null")).distinct()
    return rows.select("addr", N.private_v4(F.col("addr")).alias("narrow"), N.private_address(F.col("addr")).alias("wide"))


def port_allow(spark, sf_dir):
    rows = N.url_parts(_good_inputs(spark, sf_dir), "raw")
    return rows.select("input_id", F.col("_port").alias("port"), F.col("_port").isin(*R.PORTS).alias("allowed"))


def cache_key(spark, sf_dir):
    return N.cache_key(N.validate_url(_good_inputs(spark, sf_dir)).where("host is not null")).select("input_id", "cache_key")


def client_key(spark, sf_dir):
    return view(spark, sf_dir, "clients").select("request_id", N.client_key(F.col("proxy"), F.col("forwarded"), F.col("socket")).alias("client"))


def host_safety(spark, sf_dir):
    rows = view(spark, sf_dir, "addresses")
    return N.safe_hosts(rows.select("host").distinct(), rows.where("addr is not null")).select("host", "safe")


QUERIES = {f.__name__: f for f in (param_pick, input_errors, extract_domain, validate_url, validate_robots_domain, private_ip, port_allow, cache_key, client_key, host_safety)}


def _refusal(name: str, parse: str, private: str, port_suffix: str) -> str:
    return f"""CASE WHEN port IS NULL OR host = '' THEN '{parse}' WHEN port NOT IN ({_LIST(R.PORTS)}) THEN 'Port ' || port || ' not permitted{port_suffix}'
      WHEN {name} = '' THEN 'Missing hostname' WHEN {name} = 'localhost' THEN 'Localhost not permitted' WHEN {_PRIVATE.format(h=name)} THEN '{private}'
      WHEN NOT regexp_matches({name}, '{R.IS_ADDRESS}') AND NOT regexp_matches({name}, '{R.HOST_CHARSET.replace("{1,251}", "+")}') OR (length({name}) < 3 OR length({name}) > 253) AND NOT regexp_matches({name}, '{R.IS_ADDRESS}') THEN 'Invalid hostname' END"""


_BARE = r"regexp_replace(host, '[\[\]]', '', 'g')"
_URL_ERROR = _refusal("bare", "Could not parse URL", "Private/internal addresses not permitted", " (allowed: 80, 443, 8080, 8443)")

ORACLES = {
    "param_pick": f"""{ctes("inputs")}
SELECT input_id, coalesce(nullif(raw, ''), CASE WHEN input_id % 3 <> 0 THEN 'https://u' || input_id END) AS for_domain,
       coalesce(CASE WHEN input_id % 3 <> 0 THEN 'https://u' || input_id END, nullif(raw, '')) AS for_headers FROM inputs""",
    "input_errors": f"""{ctes("inputs")}{_PARTS}, b AS (SELECT *, {_BARE} AS bare FROM p), e AS (SELECT input_id, raw, {_URL_ERROR} AS parsed FROM b)
SELECT input_id, CASE WHEN coalesce(raw, '') = '' THEN 'Missing parameter' WHEN length(raw) > 253 THEN 'Invalid input' END AS domain_error,
  CASE WHEN coalesce(raw, '') = '' THEN 'Provide ?domain=example.com or ?url=https://example.com' WHEN length(raw) > 253 THEN 'Domain must be 253 characters or fewer' END AS domain_message,
  CASE WHEN coalesce(raw, '') = '' THEN 'Missing parameter' WHEN length(raw) > 2048 THEN 'Invalid input' WHEN parsed IS NOT NULL THEN 'Invalid URL' END AS url_error,
  CASE WHEN coalesce(raw, '') = '' THEN 'Provide ?url=https://example.com or ?domain=example.com' WHEN length(raw) > 2048 THEN 'URL must be 2048 characters or fewer' ELSE parsed END AS url_message
FROM e WHERE coalesce(raw, '') = '' OR length(raw) > 253 OR parsed IS NOT NULL""",
    "extract_domain": f"""{ctes("inputs")}, u AS (SELECT input_id, raw, CASE WHEN starts_with(raw, 'http') THEN raw ELSE 'https://' || raw END AS url FROM inputs),
p AS (SELECT *, regexp_replace({_HOST.format(u="url")}, '^www\\.', '') AS name, {_port("url")} AS port FROM u)
SELECT input_id, raw, CASE WHEN regexp_matches(url, '^https?://', 'i') AND port IS NOT NULL AND NOT regexp_matches(name, '{R.PRIVATE_V4}') AND name <> 'localhost'
  AND regexp_matches(name, '^[a-zA-Z0-9][a-zA-Z0-9\\-.]+[a-zA-Z0-9]$') AND length(name) BETWEEN 4 AND 253 AND contains(name, '.') THEN name END AS domain FROM p""",
    "validate_url": f"""{ctes("inputs")}{_PARTS}, b AS (SELECT *, {_BARE} AS bare FROM p WHERE raw IS NOT NULL), e AS (SELECT *, {_URL_ERROR} AS error FROM b)
SELECT input_id, raw, CASE WHEN error IS NULL THEN bare END AS host, error FROM e""",
    "validate_robots_domain": f"""{ctes("inputs")}{_PARTS}, b AS (SELECT *, regexp_replace({_BARE}, '^www\\.', '') AS bare FROM p WHERE raw IS NOT NULL),
e AS (SELECT *, {_refusal("bare", "Could not parse domain or URL", "Private addresses not permitted", "")} AS error FROM b)
SELECT input_id, raw, CASE WHEN error IS NULL THEN bare END AS domain, error FROM e""",
    "private_ip": f"""{ctes("inputs", "addresses")}, a AS (SELECT addr FROM addresses UNION SELECT raw FROM inputs)
SELECT addr, regexp_matches(addr, '{R.PRIVATE_V4}') AS narrow, {_PRIVATE.format(h="addr")} AS wide FROM a WHERE addr IS NOT NULL""",
    "port_allow": f"""{ctes("inputs")}{_PARTS} SELECT input_id, port, port IN ({_LIST(R.PORTS)}) AS allowed FROM p WHERE raw IS NOT NULL""",
    "cache_key": f"""{ctes("inputs")}{_PARTS}, b AS (SELECT *, {_BARE} AS bare, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1, 'i') AS path FROM p WHERE raw IS NOT NULL), e AS (SELECT *, {_URL_ERROR} AS error FROM b)
SELECT input_id, lower(split_part(url, ':', 1)) || '://' || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || CASE WHEN path = '' THEN '/' ELSE path END AS cache_key FROM e WHERE error IS NULL""",
    "client_key": f"""{ctes("clients")}
SELECT request_id, coalesce(nullif(proxy, ''), nullif(trim(split_part(forwarded, ',', 1)), ''), nullif(socket, ''), 'unknown') AS client FROM clients""",
    "host_safety": f"""{ctes("addresses")}
SELECT host, CASE WHEN regexp_matches(host, '{R.IS_ADDRESS}') THEN NOT {_PRIVATE.format(h="host")} ELSE coalesce(NOT bool_or({_PRIVATE.format(h="addr")}) FILTER (addr IS NOT NULL), false) END AS safe
FROM addresses GROUP BY host""",
}
