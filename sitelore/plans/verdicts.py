"""Queries of the four scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import to_time
from ..operators import bodies as Z
from ..operators import headers as H
from ..operators import normalize as N
from ..operators import robots as B
from ..operators import tls as C
from ..operators import trust as T
from .fixtures import HEADER_COLUMNS, HEADERS, TLS_AS_OF, TRUST_AS_OF, ctes, view

_JOIN = lambda c: F.array_join(c, "|")
_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_ANY = lambda c, xs: "(" + " OR ".join(f"contains({c}, '{x.replace(chr(39), chr(39) * 2)}')" for x in xs) + ")"


# --- trust --------------------------------------------------------------------
def observations(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inputs, registration records and DNS answers of the derived domains; the date's key and the record's presence vary."""
    d = view(spark, sf_dir, "domains")
    date = F.date_format(F.col("created").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    empty = F.lit("")
    whois = d.select("domain", F.create_map(
        F.lit("creationDate"), F.when(F.col("k") % 3 == 0, date).otherwise(empty), F.lit("created"), F.when(F.col("k") % 3 == 1, date).otherwise(empty), F.lit("domainRegistered"), F.when(F.col("k") % 3 == 2, date).otherwise(empty),
        F.lit("registrar"), F.when(F.col("k") % 2 == 0, F.col("registrar")).otherwise(empty), F.lit("registrarName"), F.col("registrar"),
    ).alias("whois"))
    dns = d.select("domain", "has_a", F.when(F.col("has_mx"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("mx"), i.cast("string"), F.lit("."), F.col("domain")))).otherwise(F.array().cast("array<string>")).alias("mx"))
    return d.select("domain"), whois, dns


def scored_trust(spark, sf_dir) -> DataFrame:
    return T.trust_score(*observations(spark, sf_dir), F.lit(TRUST_AS_OF).cast("timestamp"))


def trust_score(spark, sf_dir):
    return scored_trust(spark, sf_dir).select("domain", "age_score", "tld_score", "dns_score", "registrar_score", "score", "tier")


def domain_age_score(spark, sf_dir):
    return scored_trust(spark, sf_dir).select("domain", "age_days", "age_score", "age_label")


def tld_score(spark, sf_dir):
    """Real hosts and derived domains."""
    hosts = N.extract_domain(view(spark, sf_dir, "inputs")).select("domain").where("domain is not null")
    tld, points = T.tld_score("domain")
    return hosts.unionByName(view(spark, sf_dir, "domains").select("domain")).select(tld.alias("tld"), points.alias("tld_score")).groupBy("tld", "tld_score").agg(F.count("*").alias("n"))


def dns_presence(spark, sf_dir):
    return scored_trust(spark, sf_dir).select("domain", "has_a", "has_mx", _JOIN(F.col("mx_records")).alias("mx_records"), "dns_score")


def registrar_score(spark, sf_dir):
    return scored_trust(spark, sf_dir).select("domain", "registrar", "registrar_score")


def trust_details(spark, sf_dir):
    return scored_trust(spark, sf_dir).select("domain", "created", "expires", "age_label", "tld", "registrar", "has_a", "has_mx")


def verdict_json(spark, sf_dir):
    """The four responses as JSON text, nulls kept; every seventh comes from the cache."""
    at = lambda text: F.lit(text).cast("timestamp")
    audited = H.audit(_http(spark, sf_dir).withColumns({"final_url": F.col("url"), "hostname": N.host(F.col("url")), "status": F.lit(200), "redirects": (F.col("page_id") % 4).cast("int")}))
    policy, certs = B.crawl_policy(view(spark, sf_dir, "robots")), scored_tls(spark, sf_dir).where("error is null")
    number = lambda c, pattern: F.regexp_extract(c, pattern, 1).cast("long") % 7 == 0
    return (
        Z.body("trust", scored_trust(spark, sf_dir), at(TRUST_AS_OF), number("domain", "^d([0-9]+)")).unionByName(Z.body("tls", certs, at(TLS_AS_OF), F.col("k") % 7 == 0))
        .unionByName(Z.body("headers", audited, at(TLS_AS_OF), F.col("page_id") % 7 == 0)).unionByName(Z.body("robots", policy, at(TLS_AS_OF), number("domain", "^p([0-9]+)")))
    )


def service_documents(spark, sf_dir):
    """The free paths' answers: root, health check and description."""
    return Z.free_answers(spark, "domain intelligence", "https://api.example.org", F.lit(TRUST_AS_OF).cast("timestamp"))


# Written apart from the operators: days, points and tier of the derived domains.
_TRUST = f"""{ctes("domains")}, a AS (
  SELECT *, CASE WHEN created IS NULL THEN NULL ELSE CAST(floor((epoch_us(TIMESTAMP '{TRUST_AS_OF}') - epoch_us(created)) / 86400000000.0) AS INTEGER) END AS days, '.' || split_part(domain, '.', 2) AS tld FROM domains),
s AS (SELECT *, coalesce(days, -1) AS age_days,
  CASE WHEN days IS NULL THEN 0 WHEN days > 1825 THEN 30 WHEN days > 730 THEN 25 WHEN days > 365 THEN 18 WHEN days > 90 THEN 10 ELSE 2 END AS age_score,
  CASE WHEN days IS NULL THEN 'unknown' WHEN days > 1825 THEN 'established (5+ years)' WHEN days > 730 THEN 'mature (2–5 years)' WHEN days > 365 THEN 'growing (1–2 years)' WHEN days > 90 THEN 'new (90d–1yr)' ELSE 'very new (<90 days)' END AS age_label,
  CASE WHEN tld IN ({_LIST(R.TRUSTED_TLDS)}) THEN 20 WHEN tld IN ({_LIST(R.RISKY_TLDS)}) THEN 0 ELSE 10 END AS tld_score,
  CASE WHEN has_a THEN 20 ELSE 0 END + CASE WHEN has_mx THEN 10 ELSE 0 END AS dns_score,
  coalesce(nullif(registrar, ''), 'unknown') AS shown, CASE WHEN {_ANY("lower(registrar)", R.REGISTRARS)} THEN 20 ELSE 10 END AS registrar_score FROM a),
f AS (SELECT *, age_score + tld_score + dns_score + registrar_score AS score FROM s)"""


# --- certificates -------------------------------------------------------------
def _certificates(spark, sf_dir) -> DataFrame:
    c = view(spark, sf_dir, "certificates")
    name = lambda cn, o: F.struct(F.col(cn).alias("CN"), F.col(o).alias("O"))
    missing = F.col("k") % 101 == 0
    return c.select(
        "k", "domain", "fingerprint256", "serial_number", "chain_depth", F.when(~missing, name("subject_cn", "subject_o")).alias("subject"), F.when(~missing, name("issuer_cn", "issuer_o")).alias("issuer"), F.when(~missing, name("root_cn", "root_o")).alias("root"),
        F.date_format(F.col("valid_from").cast("timestamp"), "MMM  d HH:mm:ss yyyy 'GMT'").alias("valid_from"), F.date_format(F.col("valid_to").cast("timestamp"), "MMM  d HH:mm:ss yyyy 'GMT'").alias("valid_to"), F.col("san").alias("subjectaltname"), "authorized", "auth_error", "protocol",
        F.when(F.col("cipher").isNotNull(), F.struct(F.col("cipher").alias("name"), F.col("protocol").alias("version"))).alias("cipher"),
    )


def scored_tls(spark, sf_dir) -> DataFrame:
    return C.score(_certificates(spark, sf_dir), F.lit(TLS_AS_OF).cast("timestamp"))


def _tls(spark, sf_dir) -> DataFrame:
    return scored_tls(spark, sf_dir).where("error is null")


def tls_score(spark, sf_dir):
    return _tls(spark, sf_dir).select("domain", *[f"{c}_score" for c in C._COMPONENTS], "score")


def tls_tier(spark, sf_dir):
    return _tls(spark, sf_dir).select("domain", "days_remaining", "score", "tier")


def tls_warnings(spark, sf_dir):
    return _tls(spark, sf_dir).select("domain", _JOIN(F.col("warnings")).alias("warnings"), F.size("warnings").cast("long").alias("n"))


def tls_errors(spark, sf_dir):
    return scored_tls(spark, sf_dir).where("error is not null").select("domain", F.lit("SSL check failed").alias("error"), F.col("error").alias("message"), F.lit(502).alias("status"))


def ca_trust(spark, sf_dir):
    return _tls(spark, sf_dir).select("domain", "root_ca", C.known_ca(F.col("root"), F.col("issuer")).alias("known"), "trusted")


def self_signed(spark, sf_dir):
    return _tls(spark, sf_dir).groupBy("is_self_signed").agg(F.count("*").alias("n"), F.min("domain").alias("first_domain"))


def san_parse(spark, sf_dir):
    return _tls(spark, sf_dir).select("domain", _JOIN(F.col("san")).alias("san"), F.size("san").cast("long").alias("n"))


def cert_facts(spark, sf_dir):
    return _tls(spark, sf_dir).select("domain", "subject_name", "issuer_name", "valid_to_iso", "days_remaining")


def cipher_weak(spark, sf_dir):
    return _tls(spark, sf_dir).select(F.col("cipher")["name"].alias("cipher")).groupBy("cipher").agg(F.count("*").alias("n")).withColumn("weak", C.weak_cipher(F.col("cipher")))


def cert_chain_walk(spark, sf_dir):
    edges = view(spark, sf_dir, "cert_edges").distinct()
    return C.walk_chains(edges, edges.where("fingerprint like 's%' or fingerprint = 'x'").select("fingerprint")).select("leaf", "depth", F.col("last").alias("last_cert"))


_TLS = f"""{ctes("certificates")}, a AS (
  SELECT *, CAST(floor((epoch_us(valid_to) - epoch_us(TIMESTAMP '{TLS_AS_OF}')) / 86400000000.0) AS INTEGER) AS days,
    coalesce(subject_cn, '') = coalesce(issuer_cn, '') AND coalesce(subject_o, '') = coalesce(issuer_o, '') AS own,
    coalesce(nullif(root_o, ''), nullif(root_cn, '')) AS root_ca FROM certificates WHERE k % 101 <> 0),
b AS (SELECT *, {_ANY("coalesce(lower(root_ca), '')", R.AUTHORITIES)} OR {_ANY("coalesce(lower(issuer_o), '')", R.AUTHORITIES)} AS known, {_ANY("lower(cipher)", R.WEAK_CIPHERS)} AS weak FROM a),
c AS (SELECT *, known AND NOT own AS trusted FROM b),
s AS (SELECT *, CASE WHEN auth_error IS NOT NULL THEN 0 WHEN authorized THEN 30 ELSE 15 END AS chain_valid_score, CASE WHEN own THEN 0 WHEN trusted THEN 25 ELSE 5 END AS trusted_ca_score,
  CASE WHEN days IS NULL OR days < 0 THEN 0 WHEN days < 7 THEN 5 WHEN days < 30 THEN 15 ELSE 25 END AS not_expired_score, CASE WHEN cipher IS NULL OR weak THEN 0 ELSE 10 END AS strong_crypto_score,
  CASE WHEN protocol = 'TLSv1.3' THEN 10 WHEN protocol = 'TLSv1.2' THEN 7 WHEN protocol IS NOT NULL THEN 2 ELSE 0 END AS modern_tls_score,
  list_filter([CASE WHEN auth_error IS NOT NULL THEN 'invalid_chain' WHEN NOT authorized THEN 'chain_warning' END, 'auth_error:' || auth_error, CASE WHEN own THEN 'self_signed' WHEN NOT trusted THEN 'untrusted_ca' END,
    CASE WHEN days IS NULL THEN 'unparseable_validity' WHEN days < 0 THEN 'expired' WHEN days < 7 THEN 'expires_within_7_days' WHEN days < 30 THEN 'expires_within_30_days' END,
    CASE WHEN weak THEN 'weak_cipher' END, CASE WHEN protocol NOT IN ('TLSv1.3', 'TLSv1.2') THEN 'deprecated_tls' END], lambda x: x IS NOT NULL) AS w FROM c),
f AS (SELECT *, chain_valid_score + trusted_ca_score + not_expired_score + strong_crypto_score + modern_tls_score AS score FROM s)"""


# --- headers ------------------------------------------------------------------
def _http(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "http")
    pairs = [x for c, name in zip(HEADER_COLUMNS, HEADERS, strict=True) for x in (F.lit(name.title()), F.col(c))]
    return rows.select("page_id", "url", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("headers"))


def _one(name: str):
    def query(spark, sf_dir):
        a = F.col(name)
        return H.audit(_http(spark, sf_dir)).select("page_id", a["present"].alias("present"), a["value"].alias("value"), a["score"].alias("score"), _JOIN(a["notes"]).alias("notes"))

    return query


def header_total(spark, sf_dir):
    """From the long form, which must agree with the nested one."""
    long = H.long_form(H.audit(_http(spark, sf_dir)), "page_id")
    return long.groupBy("page_id").agg(F.sum("score").cast("int").alias("score"), F.sum("max_score").cast("int").alias("max_score"), F.count_if("present").alias("n_present"))


def header_grade(spark, sf_dir):
    return H.audit(_http(spark, sf_dir)).select("page_id", "url", "score", "grade")


def header_warnings(spark, sf_dir):
    return H.audit(_http(spark, sf_dir)).select("page_id", _JOIN(F.col("warnings")).alias("warnings"))


def redirect_follow(spark, sf_dir):
    hops = view(spark, sf_dir, "hops")
    return H.follow_redirects(hops, hops.select("url"))


def _sql_analysis(v: str, score: str, notes: list[str], shown: str | None = None) -> str:
    listed = f"array_to_string(list_filter([{', '.join(notes)}], lambda x: x IS NOT NULL), '|')" if notes else "''"
    gone = f"coalesce({v}, '') = ''"
    return f"NOT ({gone}) AS present, CASE WHEN NOT ({gone}) THEN {shown or v} END AS value, CASE WHEN {gone} THEN 0 ELSE {score} END AS score, CASE WHEN {gone} THEN 'missing' ELSE {listed} END AS notes"


_AGE = "coalesce(TRY_CAST(regexp_extract(hsts, 'max-age=([0-9]+)', 1, 'i') AS DOUBLE), 0)"
_SUB = "regexp_matches(hsts, 'includeSubDomains', 'i')"
_WILD = "(contains(csp, '*') AND NOT regexp_matches(csp, 'strict-dynamic', 'i'))"
_REF = "(" + " OR ".join(f"contains(lower(referrer), '{x}')" for x in R.REFERRER_POLICIES) + ")"
_NAMED, _BY = "coalesce(server, '') <> ''", "coalesce(powered, '') <> ''"
_SQL = {
    "hsts": _sql_analysis("hsts", f"8 + CASE WHEN {_AGE} >= 31536000 THEN 7 WHEN {_AGE} >= 15768000 THEN 4 ELSE 0 END + CASE WHEN {_SUB} THEN 3 ELSE 0 END + CASE WHEN regexp_matches(hsts, 'preload', 'i') THEN 2 ELSE 0 END", [f"CASE WHEN {_AGE} < 15768000 THEN 'max_age_too_short' WHEN {_AGE} < 31536000 THEN 'max_age_short' END", f"CASE WHEN NOT {_SUB} THEN 'missing_includeSubDomains' END"]),
    "csp": _sql_analysis("csp", f"greatest(0, least(20, 10 - CASE WHEN contains(lower(csp), 'unsafe-inline') THEN 4 ELSE 0 END - CASE WHEN contains(lower(csp), 'unsafe-eval') THEN 4 ELSE 0 END + CASE WHEN {_WILD} THEN 0 ELSE 5 END + CASE WHEN contains(lower(csp), 'default-src') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(csp, 'frame-ancestors\\s+(none|''self'')', 'i') THEN 2 ELSE 0 END))", ["CASE WHEN contains(lower(csp), 'unsafe-inline') THEN 'uses_unsafe_inline' END", "CASE WHEN contains(lower(csp), 'unsafe-eval') THEN 'uses_unsafe_eval' END", f"CASE WHEN {_WILD} THEN 'wildcard_source' END"], "CASE WHEN length(csp) > 200 THEN substr(csp, 1, 200) || '…' ELSE csp END"),
    "xFrameOptions": _sql_analysis("xfo", "CASE upper(xfo) WHEN 'DENY' THEN 10 WHEN 'SAMEORIGIN' THEN 8 ELSE 3 END", ["CASE WHEN upper(xfo) NOT IN ('DENY', 'SAMEORIGIN') THEN 'weak_value' END"]),
    "xContentTypeOptions": _sql_analysis("xcto", "CASE lower(xcto) WHEN 'nosniff' THEN 10 ELSE 3 END", ["CASE WHEN lower(xcto) <> 'nosniff' THEN 'weak_value' END"]),
    "referrerPolicy": _sql_analysis("referrer", f"CASE WHEN {_REF} THEN 10 WHEN contains(lower(referrer), 'unsafe-url') THEN 0 ELSE 5 END", [f"CASE WHEN NOT {_REF} AND contains(lower(referrer), 'unsafe-url') THEN 'unsafe_policy' END"]),
    "permissionsPolicy": _sql_analysis("permissions", "10", [], "CASE WHEN length(permissions) > 150 THEN substr(permissions, 1, 150) || '…' ELSE permissions END"),
    "coop": _sql_analysis("coop", "CASE lower(coop) WHEN 'same-origin' THEN 10 WHEN 'same-origin-allow-popups' THEN 7 ELSE 3 END", ["CASE WHEN lower(coop) NOT IN ('same-origin', 'same-origin-allow-popups') THEN 'weak_value' END"]),
    "serverDisclosure": f"({_NAMED} OR {_BY}) AS present, coalesce(nullif(server, ''), nullif(powered, '')) AS value, greatest(0, 10 - CASE WHEN {_NAMED} THEN CASE WHEN regexp_matches(server, '[0-9]+\\.[0-9]+') THEN 5 ELSE 2 END ELSE 0 END - CASE WHEN {_BY} THEN 5 ELSE 0 END) AS score, array_to_string(list_filter([CASE WHEN {_NAMED} THEN CASE WHEN regexp_matches(server, '[0-9]+\\.[0-9]+') THEN 'server_version_disclosed' ELSE 'server_disclosed' END END, CASE WHEN {_BY} THEN 'x_powered_by_disclosed' END], lambda x: x IS NOT NULL), '|') AS notes",
}
_SINGLE = {"hsts_score": "hsts", "csp_score": "csp", "xfo_score": "xFrameOptions", "xcto_score": "xContentTypeOptions", "referrer_score": "referrerPolicy", "permissions_score": "permissionsPolicy", "coop_score": "coop", "server_disclosure": "serverDisclosure"}
_ALL = ctes("http") + ", long AS (" + " UNION ALL ".join(f"SELECT page_id, url, {i} AS place, '{n}' AS analysis, {'20' if i < 2 else '10'} AS most, {sql} FROM http" for i, (n, sql) in enumerate(_SQL.items())) + ")"


# --- robots -------------------------------------------------------------------
def _policy(spark, sf_dir) -> DataFrame:
    return B.crawl_policy(view(spark, sf_dir, "robots"))


def robots_exists(spark, sf_dir):
    return _policy(spark, sf_dir).select("domain", "status", "exists", F.coalesce(F.length("body"), F.lit(0)).cast("long").alias("body_chars"))


def robots_groups(spark, sf_dir):
    rows = _policy(spark, sf_dir).select("domain", F.posexplode("groups").alias("pos", "g"))
    return rows.select("domain", (F.col("pos") + 1).cast("long").alias("gid"), F.col("g.userAgent").alias("agent"), _JOIN(F.col("g.allow")).alias("allow"), _JOIN(F.col("g.disallow")).alias("disallow"), F.col("g.crawlDelay").alias("crawl_delay"))


def robots_sitemaps(spark, sf_dir):
    return _policy(spark, sf_dir).select("domain", F.posexplode("sitemaps").alias("pos", "sitemap")).withColumn("pos", F.col("pos").cast("long"))


def robots_global(spark, sf_dir):
    return _policy(spark, sf_dir).where("exists").select("domain", "global_block", "global_allow")


def ai_bot_policies(spark, sf_dir):
    rows = _policy(spark, sf_dir).where("exists").select("domain", F.explode("policies").alias("p"))
    return rows.select("domain", "p.bot", "p.blocked", "p.partial", _JOIN(F.col("p.rules.allow")).alias("allow"), _JOIN(F.col("p.rules.disallow")).alias("disallow"))


def robots_summary(spark, sf_dir):
    return _policy(spark, sf_dir).where("exists").select("domain", F.size("groups").cast("long").alias("n_groups"), F.size("sitemaps").cast("long").alias("n_sitemaps"), "raw_lines", "has_errors", "blocked", "partial")


def robots_tier(spark, sf_dir):
    return _policy(spark, sf_dir).select("domain", "tier", "friendly")


def robots_fetch_fallback(spark, sf_dir):
    return B.choose_source(view(spark, sf_dir, "robots_tries")).select("domain", "scheme", "status", "body", "error")


def robots_truncate(spark, sf_dir):
    body, more = B.truncated_body(F.col("body"))
    return view(spark, sf_dir, "long_bodies").select("page_id", F.octet_length(body).cast("long").alias("kept_bytes"), more.alias("truncated"), F.sha2(body, 256).alias("kept_sha256"))


_ROBOTS = f"""{ctes("robots")}, lines AS (SELECT domain, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM robots WHERE status = 200),
clean AS (SELECT domain, pos, trim(regexp_replace(raw, '#.*$', '')) AS t FROM lines),
rules AS (SELECT domain, pos, lower(trim(split_part(t, ':', 1))) AS d, trim(substr(t, strpos(t, ':') + 1)) AS v FROM clean WHERE strpos(t, ':') > 0),
placed AS (SELECT *, sum(CASE WHEN d = 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gid FROM rules),
groups AS (SELECT domain, CAST(gid AS BIGINT) AS gid, max(v) FILTER (d = 'user-agent') AS agent, coalesce(list(v ORDER BY pos) FILTER (d = 'allow'), []) AS allow, coalesce(list(v ORDER BY pos) FILTER (d = 'disallow'), []) AS disallow,
  arg_max(TRY_CAST(nullif(regexp_extract(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE), pos) FILTER (d = 'crawl-delay') AS crawl_delay FROM placed WHERE gid > 0 GROUP BY domain, gid),
star AS (SELECT domain, arg_min(disallow, gid) AS disallow FROM groups WHERE agent = '*' GROUP BY domain),
flags AS (SELECT r.domain, coalesce(list_contains(s.disallow, '/') OR list_contains(s.disallow, ''), false) AS global_block, coalesce(len(list_filter(s.disallow, lambda x: x <> '')) = 0, true) AS global_allow
  FROM robots r LEFT JOIN star s ON r.domain = s.domain WHERE r.status = 200),
bots AS (SELECT unnest([{_LIST(R.BOTS)}]) AS bot),
own AS (SELECT g.domain, b.bot, arg_min(g.allow, gid) AS allow, arg_min(g.disallow, gid) AS disallow FROM groups g JOIN bots b ON lower(g.agent) = lower(b.bot) GROUP BY g.domain, b.bot),
policy AS (SELECT f.domain, b.bot, o.domain IS NOT NULL AS named, list_contains(o.disallow, '/') OR list_contains(o.disallow, '') AS root, o.allow, o.disallow, global_block FROM flags f CROSS JOIN bots b LEFT JOIN own o ON o.domain = f.domain AND o.bot = b.bot),
judged AS (SELECT domain, bot, CASE WHEN named THEN root AND len(allow) = 0 ELSE global_block END AS blocked, CASE WHEN named THEN NOT root AND len(list_filter(disallow, lambda x: x <> '')) > 0 ELSE false END AS partial,
  coalesce(array_to_string(allow, '|'), '') AS allow, coalesce(array_to_string(disallow, '|'), '') AS disallow FROM policy),
counts AS (SELECT domain, CAST(count_if(blocked) AS BIGINT) AS blocked, CAST(count_if(partial) AS BIGINT) AS partial FROM judged GROUP BY domain)"""

QUERIES = {
    f.__name__: f
    for f in (
        trust_score, domain_age_score, tld_score, dns_presence, registrar_score, trust_details, verdict_json, service_documents, tls_score, tls_tier, tls_warnings, tls_errors, ca_trust, self_signed, san_parse, cert_facts, cipher_weak, cert_chain_walk,
        header_total, header_grade, header_warnings, redirect_follow, robots_exists, robots_groups, robots_sitemaps, robots_global, ai_bot_policies, robots_summary, robots_tier, robots_fetch_fallback, robots_truncate,
    )
} | {query: _one(name) for query, name in _SINGLE.items()}

_DATE = "strftime(created, '%Y-%m-%dT%H:%M:%SZ')"
ORACLES = {
    "trust_score": f"{_TRUST} SELECT domain, age_score, tld_score, dns_score, registrar_score, score, CASE WHEN score >= 75 THEN 'TRUSTED' WHEN score >= 50 THEN 'MODERATE' WHEN score >= 25 THEN 'CAUTION' ELSE 'HIGH_RISK' END AS tier FROM f",
    "domain_age_score": f"{_TRUST} SELECT domain, age_days, age_score, age_label FROM f",
    "tld_score": None,
    "dns_presence": f"{_TRUST} SELECT domain, has_a, has_mx, CASE WHEN has_mx THEN 'mx1.' || domain || '|mx2.' || domain || '|mx3.' || domain ELSE '' END AS mx_records, dns_score FROM f",
    "registrar_score": f"{_TRUST} SELECT domain, shown AS registrar, registrar_score FROM f",
    "trust_details": f"{_TRUST} SELECT domain, CASE WHEN k % 3 = 0 THEN {_DATE} END AS created, CAST(NULL AS VARCHAR) AS expires, age_label, tld, shown AS registrar, has_a, has_mx FROM f",
    "tls_score": f"{_TLS} SELECT domain, chain_valid_score, trusted_ca_score, not_expired_score, strong_crypto_score, modern_tls_score, score FROM f",
    "tls_tier": f"{_TLS} SELECT domain, days AS days_remaining, score, CASE WHEN days < 0 THEN 'EXPIRED' WHEN own THEN 'UNTRUSTED' WHEN auth_error IS NOT NULL THEN 'INVALID' WHEN NOT trusted THEN 'UNTRUSTED' WHEN days < 7 THEN 'EXPIRING' WHEN score < 70 THEN 'WEAK' ELSE 'VALID' END AS tier FROM f",
    "tls_warnings": f"{_TLS} SELECT domain, array_to_string(w, '|') AS warnings, CAST(len(w) AS BIGINT) AS n FROM f",
    "tls_errors": f"{ctes('certificates')} SELECT domain, 'SSL check failed' AS error, 'No certificate presented' AS message, 502 AS status FROM certificates WHERE k % 101 = 0",
    "ca_trust": f"{_TLS} SELECT domain, root_ca, known, trusted FROM f",
    "self_signed": f"{_TLS} SELECT own AS is_self_signed, count(*) AS n, min(domain) AS first_domain FROM f GROUP BY own",
    "san_parse": f"{_TLS}, p AS (SELECT domain, list_filter(list_transform(string_split(coalesce(san, ''), ','), lambda x: regexp_replace(trim(x), '^DNS:', '', 'i')), lambda x: x <> '')[1:20] AS l FROM f) SELECT domain, array_to_string(l, '|') AS san, CAST(len(l) AS BIGINT) AS n FROM p",
    "cert_facts": f"{_TLS} SELECT domain, coalesce(nullif(subject_cn, ''), nullif(subject_o, ''), domain) AS subject_name, coalesce(nullif(issuer_o, ''), nullif(issuer_cn, ''), 'unknown') AS issuer_name, strftime(valid_to, '%Y-%m-%dT%H:%M:%S.000Z') AS valid_to_iso, days AS days_remaining FROM f",
    "cipher_weak": f"{_TLS} SELECT cipher, count(*) AS n, bool_or(weak) AS weak FROM f GROUP BY cipher",
    "cert_chain_walk": f"""{ctes("cert_edges")}, walk(leaf, cur, depth, seen) AS (
  SELECT DISTINCT fingerprint, fingerprint, 1, [fingerprint] FROM cert_edges WHERE fingerprint LIKE 's%' OR fingerprint = 'x'
  UNION ALL SELECT w.leaf, e.issuer_fingerprint, w.depth + 1, list_append(w.seen, e.issuer_fingerprint) FROM walk w JOIN (SELECT DISTINCT * FROM cert_edges) e ON e.fingerprint = w.cur WHERE NOT list_contains(w.seen, e.issuer_fingerprint))
SELECT leaf, CAST(max(depth) AS INTEGER) AS depth, arg_max(cur, depth) AS last_cert FROM walk GROUP BY leaf""",
    **{q: f"{ctes('http')} SELECT page_id, {_SQL[n]} FROM http" for q, n in _SINGLE.items()},
    "header_total": f"{_ALL} SELECT page_id, CAST(sum(score) AS INTEGER) AS score, CAST(sum(most) AS INTEGER) AS max_score, CAST(count_if(present) AS BIGINT) AS n_present FROM long GROUP BY page_id",
    "header_grade": f"{_ALL}, t AS (SELECT page_id, url, CAST(sum(score) AS INTEGER) AS score FROM long GROUP BY page_id, url) SELECT *, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade FROM t",
    "header_warnings": f"{_ALL}, w AS (SELECT page_id, place, CASE WHEN NOT present THEN ['missing_' || analysis] WHEN notes = '' THEN [] ELSE list_transform(string_split(notes, '|'), lambda x: analysis || ':' || x) END AS l FROM long) SELECT page_id, array_to_string(flatten(list(l ORDER BY place)), '|') AS warnings FROM w GROUP BY page_id",
    "redirect_follow": f"""{ctes("hops")}, targets AS (
  SELECT url, status, CASE WHEN location = '/login?next=1' THEN url || 'login?next=1' WHEN location = 'x/./z/../y' THEN url || 'x/y' WHEN starts_with(location, '//') THEN 'https:' || lower(split_part(location, ':', 1)) || '/' ELSE location END AS location FROM hops),
walk(start, url, redirects, error) AS (
  SELECT DISTINCT url, url, 0, CAST(NULL AS VARCHAR) FROM hops
  UNION ALL SELECT w.start, h.location, w.redirects + 1, CASE WHEN NOT starts_with(h.location, 'http') THEN 'Refused redirect to ' || split_part(h.location, ':', 1) || ': scheme'
      WHEN contains(h.location, ':22/') THEN 'Refused redirect to port 22' WHEN w.redirects = 3 THEN 'Too many redirects (max 3)' WHEN contains(h.location, '//10.') THEN 'Refused: hostname 10.0.0.5 resolves to a private address' END
  FROM walk w JOIN targets h ON h.url = w.url WHERE h.status = 302 AND w.error IS NULL AND w.redirects <= 3)
SELECT start, arg_max(url, redirects) AS final_url, CAST(max(redirects) AS INTEGER) AS redirects, max(error) AS error FROM walk GROUP BY start""",
    "robots_exists": f"{ctes('robots')} SELECT domain, status, status = 200 AS \"exists\", CASE WHEN status = 200 THEN length(body) ELSE 0 END AS body_chars FROM robots",
    "robots_groups": f"{_ROBOTS} SELECT domain, gid, agent, array_to_string(allow, '|') AS allow, array_to_string(disallow, '|') AS disallow, crawl_delay FROM groups",
    "robots_sitemaps": f"{_ROBOTS} SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY pos) - 1 AS pos, v AS sitemap FROM rules WHERE d = 'sitemap' AND v <> ''",
    "robots_global": f"{_ROBOTS} SELECT domain, global_block, global_allow FROM flags",
    "ai_bot_policies": f"{_ROBOTS} SELECT domain, bot, blocked, partial, allow, disallow FROM judged",
    "robots_summary": f"""{_ROBOTS} SELECT c.domain, (SELECT count(*) FROM groups g WHERE g.domain = c.domain) AS n_groups, (SELECT count(*) FROM rules r WHERE r.domain = c.domain AND d = 'sitemap' AND v <> '') AS n_sitemaps,
  (SELECT count(*) FROM lines l WHERE l.domain = c.domain) AS raw_lines, (SELECT coalesce(bool_or(t <> '' AND NOT contains(t, ':')), false) FROM clean l WHERE l.domain = c.domain) AS has_errors, c.blocked, c.partial FROM counts c""",
    "robots_tier": f"""{_ROBOTS}, t AS (SELECT r.domain, CASE WHEN r.status <> 200 THEN 'NO_ROBOTS_TXT' WHEN global_block AND blocked = 24 THEN 'BLOCKED_ALL' WHEN blocked > 12 THEN 'BLOCKED_AI' WHEN blocked > 0 OR partial > 8 THEN 'SELECTIVE' ELSE 'OPEN' END AS tier
  FROM robots r LEFT JOIN flags f ON f.domain = r.domain LEFT JOIN counts c ON c.domain = r.domain) SELECT domain, tier, tier NOT IN ('BLOCKED_ALL', 'BLOCKED_AI') AS friendly FROM t""",
    "robots_fetch_fallback": f"""{ctes("robots_tries")}, s AS (SELECT * FROM robots_tries WHERE scheme = 'https'), h AS (SELECT * FROM robots_tries WHERE scheme = 'http')
SELECT s.domain, CASE WHEN s.error IS NULL THEN 'https' ELSE 'http' END AS scheme, CASE WHEN s.error IS NULL THEN s.status ELSE h.status END AS status, CASE WHEN s.error IS NULL THEN s.body ELSE h.body END AS body, CASE WHEN s.error IS NULL THEN NULL ELSE h.error END AS error FROM s JOIN h ON s.domain = h.domain""",
    "robots_truncate": f"{ctes('long_bodies')} SELECT page_id, least(strlen(body), 102400) AS kept_bytes, strlen(body) > 102400 AS truncated, sha256(substr(body, 1, 102400)) AS kept_sha256 FROM long_bodies",
}


def _json_oracle() -> str:
    """The four bodies from the CTEs of the flat oracles."""
    meta = lambda at, cached: f"{{'checkedAt': strftime(TIMESTAMP '{at}', '%Y-%m-%dT%H:%M:%S.000Z'), 'apiVersion': '{R.API_VERSION}', 'paidWith': '{R.PAID_WITH}', 'cached': {cached}}}"
    stamp = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.000Z')"
    trust = f"""{_TRUST}, t AS (SELECT *, CASE WHEN score >= 75 THEN 'TRUSTED' WHEN score >= 50 THEN 'MODERATE' WHEN score >= 25 THEN 'CAUTION' ELSE 'HIGH_RISK' END AS tier FROM f)
SELECT 'trust' AS kind, domain AS key, CAST(to_json({{'domain': domain, 'score': score, 'maxScore': 100, 'tier': tier,
  'breakdown': {{'domainAge': age_score, 'tld': tld_score, 'dnsPresence': dns_score, 'registrar': registrar_score}},
  'details': {{'age': {{'days': age_days, 'label': age_label, 'created': CASE WHEN k % 3 = 0 THEN {_DATE} END, 'expires': CAST(NULL AS VARCHAR)}}, 'tld': tld,
    'dns': {{'hasARecord': has_a, 'hasMxRecord': has_mx, 'mxRecords': CASE WHEN has_mx THEN ['mx1.' || domain, 'mx2.' || domain, 'mx3.' || domain] ELSE CAST([] AS VARCHAR[]) END}}, 'registrar': shown}},
  'meta': {meta(TRUST_AS_OF, "k % 7 = 0")}}}) AS VARCHAR) AS body FROM t"""
    tls = f"""{_TLS}, t AS (SELECT *, CASE WHEN days < 0 THEN 'EXPIRED' WHEN own THEN 'UNTRUSTED' WHEN auth_error IS NOT NULL THEN 'INVALID' WHEN NOT trusted THEN 'UNTRUSTED' WHEN days < 7 THEN 'EXPIRING' WHEN score < 70 THEN 'WEAK' ELSE 'VALID' END AS tier,
  list_filter(list_transform(string_split(coalesce(san, ''), ','), lambda x: regexp_replace(trim(x), '^DNS:', '', 'i')), lambda x: x <> '')[1:20] AS names FROM f)
SELECT 'tls' AS kind, domain AS key, CAST(to_json({{'domain': domain, 'score': score, 'maxScore': 100, 'tier': tier,
  'breakdown': {{'chainValid': chain_valid_score, 'trustedCa': trusted_ca_score, 'notExpired': not_expired_score, 'strongCrypto': strong_crypto_score, 'modernTls': modern_tls_score}}, 'warnings': w,
  'certificate': {{'subject': coalesce(nullif(subject_cn, ''), nullif(subject_o, ''), domain), 'issuer': coalesce(nullif(issuer_o, ''), nullif(issuer_cn, ''), 'unknown'), 'validFrom': {stamp("valid_from")}, 'validTo': {stamp("valid_to")},
    'daysRemaining': days, 'san': names, 'fingerprint256': coalesce(fingerprint256, ''), 'serialNumber': coalesce(serial_number, ''), 'isSelfSigned': own}},
  'chain': {{'depth': chain_depth, 'valid': auth_error IS NULL, 'trusted': trusted, 'rootCa': root_ca}},
  'connection': {{'protocol': protocol, 'cipher': CASE WHEN cipher IS NOT NULL THEN {{'name': cipher, 'version': protocol}} END, 'authorized': authorized, 'authError': auth_error}},
  'meta': {meta(TLS_AS_OF, "k % 7 = 0")}}}) AS VARCHAR) AS body FROM t"""
    analyses = ", ".join(f"'{n}': any_value(s) FILTER (analysis = '{n}')" for n in _SQL)
    headers = f"""{_ALL}, h AS (SELECT page_id, url, score, most, place, analysis, CASE WHEN notes = '' THEN [] ELSE string_split(notes, '|') END AS n, present, value FROM long),
g AS (SELECT page_id, url, CAST(sum(score) AS INTEGER) AS total, CAST(sum(most) AS INTEGER) AS top,
    flatten(list(CASE WHEN NOT present THEN ['missing_' || analysis] ELSE list_transform(n, lambda x: analysis || ':' || x) END ORDER BY place)) AS w, {{{analyses}}} AS a
  FROM (SELECT *, {{'present': present, 'value': value, 'score': score, 'maxScore': most, 'notes': n}} AS s FROM h) GROUP BY page_id, url)
SELECT 'headers' AS kind, url AS key, CAST(to_json({{'url': url, 'hostname': lower(regexp_extract(url, '^https?://([^/?#:]*)', 1, 'i')),
  'grade': CASE WHEN total >= 90 THEN 'A+' WHEN total >= 80 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 50 THEN 'C' WHEN total >= 30 THEN 'D' ELSE 'F' END, 'score': total, 'maxScore': top, 'analysis': a, 'warnings': w,
  'response': {{'status': 200, 'redirects': page_id % 4}}, 'meta': {meta(TLS_AS_OF, "page_id % 7 = 0")}}}) AS VARCHAR) AS body FROM g"""
    robots = f"""{_ROBOTS}, p AS (SELECT r.page_id, r.domain, r.status, f.global_block, f.global_allow, c.blocked, c.partial,
    (SELECT coalesce(list({{'userAgent': agent, 'allow': allow, 'disallow': disallow, 'crawlDelay': crawl_delay}} ORDER BY gid), []) FROM groups g WHERE g.domain = r.domain) AS gs,
    (SELECT coalesce(list(v ORDER BY pos), []) FROM rules x WHERE x.domain = r.domain AND d = 'sitemap' AND v <> '') AS maps, (SELECT count(*) FROM lines l WHERE l.domain = r.domain) AS n,
    (SELECT coalesce(bool_or(t <> '' AND NOT contains(t, ':')), false) FROM clean l WHERE l.domain = r.domain) AS bad,
    (SELECT list({{'bot': p.bot, 'blocked': j.blocked, 'partial': j.partial, 'rules': {{'allow': coalesce(p.allow, []), 'disallow': coalesce(p.disallow, [])}}}} ORDER BY list_position([{_LIST(R.BOTS)}], p.bot)) FROM policy p JOIN judged j ON p.domain = j.domain AND p.bot = j.bot WHERE p.domain = r.domain) AS pol
  FROM robots r LEFT JOIN flags f ON f.domain = r.domain LEFT JOIN counts c ON c.domain = r.domain),
q AS (SELECT *, status = 200 AS there, CASE WHEN status <> 200 THEN 'NO_ROBOTS_TXT' WHEN global_block AND blocked = 24 THEN 'BLOCKED_ALL' WHEN blocked > 12 THEN 'BLOCKED_AI' WHEN blocked > 0 OR partial > 8 THEN 'SELECTIVE' ELSE 'OPEN' END AS tier FROM p)
SELECT 'robots' AS kind, domain AS key, CAST(to_json({{'domain': domain, 'exists': there, 'tier': tier, 'aiFriendly': tier NOT IN ('BLOCKED_ALL', 'BLOCKED_AI'),
  'summary': CASE WHEN there THEN {{'userAgentGroups': len(gs), 'sitemaps': len(maps), 'rawLines': n, 'truncated': false, 'hasParseErrors': bad}} END,
  'ai': CASE WHEN there THEN {{'globalBlock': global_block, 'globalAllow': global_allow, 'knownBotsChecked': 24, 'knownBotsBlocked': blocked, 'knownBotsPartial': partial, 'policies': pol}} END,
  'sitemaps': maps, 'userAgents': gs, 'response': {{'status': status}}, 'meta': {meta(TLS_AS_OF, "page_id % 7 = 0")}}}) AS VARCHAR) AS body FROM q"""
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (trust, tls, headers, robots))


def _tld_oracle() -> str:
    from .inputs import ORACLES as INPUT

    return f"""WITH extracted AS ({INPUT["extract_domain"]}), {ctes("domains").removeprefix("WITH RECURSIVE ")},
d AS (SELECT domain FROM extracted WHERE domain IS NOT NULL UNION ALL SELECT domain FROM domains), t AS (SELECT '.' || lower(split_part(domain, '.', -1)) AS tld FROM d)
SELECT tld, CASE WHEN tld IN ({_LIST(R.TRUSTED_TLDS)}) THEN 20 WHEN tld IN ({_LIST(R.RISKY_TLDS)}) THEN 0 ELSE 10 END AS tld_score, count(*) AS n FROM t GROUP BY tld"""


ORACLES["tld_score"] = _tld_oracle()
ORACLES["verdict_json"] = _json_oracle()
