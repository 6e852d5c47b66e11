"""Observation tables derived from the test tables.

No test table holds registrations, certificates, headers or robots.txt bodies, so
they are derived by integer arithmetic, in SQL that Spark and DuckDB share.
``dialect`` settles the few words that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import refdata as R

TRUST_AS_OF, TLS_AS_OF = "2001-06-01 00:00:00", "1998-01-01 00:00:00"


def _choose(key: str, modulus: int, values: list[str | None]) -> str:
    """A CASE over ``key % modulus``; values are texts, None is null."""
    arms = " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE CAST({key} % {modulus} AS INT) {arms} END"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(_quote(p) for p in parts)


BAD_INPUTS = ["", "httpbin.org", "localhost", "10.0.0.1", "169.254.1.1", "a.b:22", "FTP://x.com", "x..", "[::1]", None]
INPUTS = f"""
SELECT page_id AS input_id, url AS raw FROM pages
UNION ALL SELECT 1000000 + page_id, CASE WHEN page_id % 10 = 9 THEN repeat('a', 254) ELSE {_choose("page_id", 10, BAD_INPUTS)} END FROM pages
UNION ALL SELECT 2000000 + page_id, {_choose("page_id", 10, ["www.Example.COM/x?y#z", "HTTP://x.io", "https://user@h.net:443/p", "http://w.dev:80", "https://w.dev:8443/a/b?c", "http://a_b.com", "172.20.0.1", "http", "fe80::1", "https://h.org:99999/"])} FROM pages"""

TLDS = [".com", ".xyz", ".info", ".ai", ".tk", ".top", ".org"]
REGISTRARS = ["GoDaddy.com, LLC", "", "Obscure Names Ltd", "MarkMonitor, Inc.", None]
DOMAINS = f"""
SELECT o_orderkey AS k, 'd' || CAST(o_orderkey AS STRING) || {_choose("o_orderkey", 7, TLDS)} AS domain,
       CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS created, {_choose("o_orderkey", 5, REGISTRARS)} AS registrar,
       o_orderkey % 10 <> 0 AS has_a, o_orderkey % 3 <> 0 AS has_mx
FROM orders"""

CIPHERS = ["TLS_AES_256_GCM_SHA384", "ECDHE-RSA-AES128-GCM-SHA256", "DES-CBC3-SHA", "AES256-SHA", None]
PROTOCOLS = ["TLSv1.3", "TLSv1.2", "TLSv1", None]
ISSUERS = ["DigiCert Inc", "Let''s Encrypt".replace("''", "'"), "Acme Internal", None]
SANS = ["DNS:a.org, dns:b.org,,IP Address:1.2.3.4", None, ",".join(f"DNS:h{i}.net" for i in range(25)), " , "]
CERTIFICATES = f"""
SELECT o_orderkey AS k, 'd' || CAST(o_orderkey AS STRING) || '.com' AS domain, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS valid_to,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate - INTERVAL 90 DAY END AS valid_from, CASE WHEN o_orderkey % 6 <> 0 THEN 'AB:' || CAST(o_orderkey AS STRING) END AS fingerprint256,
       CASE WHEN o_orderkey % 8 <> 0 THEN '0' || CAST(o_orderkey AS STRING) END AS serial_number, CAST(o_orderkey % 4 AS INT) + 1 AS chain_depth,
       CASE WHEN o_orderkey % 19 = 0 THEN 'self' ELSE 'd' || CAST(o_orderkey AS STRING) || '.com' END AS subject_cn,
       CASE WHEN o_orderkey % 38 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'self' ELSE 'Issuing CA' END AS issuer_cn,
       CASE WHEN o_orderkey % 38 = 19 THEN 'O' ELSE NULL END AS subject_o,
       CASE WHEN o_orderkey % 38 = 19 THEN 'O' WHEN o_orderkey % 19 = 0 THEN NULL ELSE {_choose("o_orderkey", 4, ISSUERS)} END AS issuer_o,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {_choose("o_orderkey", 3, ["GlobalSign", "Unheard Of Root", ""])} END AS root_o,
       CASE WHEN o_orderkey % 2 = 0 THEN 'ISRG by Sectigo' END AS root_cn,
       {_choose("o_orderkey", 4, SANS)} AS san, o_orderkey % 29 <> 0 AS authorized,
       CASE WHEN o_orderkey % 17 = 0 THEN 'CERT_HAS_EXPIRED' WHEN o_orderkey % 17 = 1 THEN 'UNABLE_TO_VERIFY' END AS auth_error,
       {_choose("o_orderkey", 4, PROTOCOLS)} AS protocol, {_choose("o_orderkey", 5, CIPHERS)} AS cipher
FROM orders"""

CERT_EDGES = """
SELECT 's' || CAST(s_suppkey AS STRING) AS fingerprint, 'n' || CAST(s_nationkey AS STRING) AS issuer_fingerprint FROM supplier
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM nation
UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'r' || CAST(r_regionkey AS STRING) FROM region
UNION ALL SELECT 'x', 'y' UNION ALL SELECT 'y', 'x'"""

HEADERS = {
    "strict-transport-security": (6, ["max-age=31536000; includeSubDomains; preload", "Max-Age=15768000", "max-age=300; includesubdomains", "", 'max-age="31536000"', None]),
    "content-security-policy": (7, ["default-src 'self'; frame-ancestors 'self'", "default-src * 'unsafe-inline' 'unsafe-eval'", "script-src 'strict-dynamic' *", "frame-ancestors 'none'", "img-src *", "default-src 'self'; frame-ancestors none", None]),
    "x-frame-options": (4, ["deny", "SAMEORIGIN", "ALLOW-FROM x", None]),
    "x-content-type-options": (3, ["NoSniff", "x", None]),
    "referrer-policy": (5, ["no-referrer-when-downgrade", "unsafe-url", "origin", "Strict-Origin", None]),
    "permissions-policy": (2, ["camera=()", None]),
    "cross-origin-opener-policy": (4, ["same-origin", "same-origin-allow-popups", "unsafe-none", None]),
    "server": (9, ["nginx/1.18.0", "nginx", "cloudflare", None, None, None, None, None, None]),
    "x-powered-by": (8, ["PHP/8.1", None, None, None, None, None, None, None]),
}
#: Short names of the headers as columns.
HEADER_COLUMNS = ("hsts", "csp", "xfo", "xcto", "referrer", "permissions", "coop", "server", "powered")
HTTP = "SELECT page_id, url" + "".join(f", {_choose('page_id', m, v)} AS {c}" for c, (m, v) in zip(HEADER_COLUMNS, HEADERS.values(), strict=True)) + " FROM pages"

HOPS = """
SELECT 'https://p' || CAST(page_id AS STRING) || '.net/' AS url, CASE WHEN page_id % 5 = 0 THEN 200 ELSE 302 END AS status,
       CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 35 = 1 THEN 'ftp://p.net/' WHEN page_id % 35 = 6 THEN 'https://p.net:22/' WHEN page_id % 35 = 11 THEN 'http://10.0.0.5/in'
       WHEN page_id % 35 = 16 THEN '/login?next=1' WHEN page_id % 35 = 21 THEN '//P' || CAST(page_id - 1 AS STRING) || '.net:443' WHEN page_id % 35 = 31 THEN 'x/./z/../y' ELSE 'https://p' || CAST(page_id - 1 AS STRING) || '.net/' END AS location
FROM pages"""

_B = R.BOTS
_BODIES = [
    _lines("User-agent: *", "Disallow:"), _lines("User-agent: *", "Disallow: /private"), _lines("User-agent: GPTBot", "Disallow: /"),
    _lines(*[x for b in _B[:13] for x in (f"User-agent: {b}", "Disallow: /")]), _lines("User-agent: *", "Disallow: /", "User-agent: gptbot", "Disallow: /x"),
    _lines("User-agent: GPTBot", "User-agent: CCBot", "Disallow: /"), _lines(*[x for b in _B[:9] for x in (f"User-agent: {b}", "Disallow: /p")]),
    _lines("# hi", "Disallow: /lost", "broken", "User-agent: *", "Crawl-delay: 10s", "Allow: /", "Sitemap: https://e.org/s.xml#x"),
]
ROBOTS = "SELECT page_id, 'p' || CAST(page_id AS STRING) || '.net' AS domain, CASE WHEN page_id % 9 = 8 THEN 404 ELSE 200 END AS status, CASE CAST(page_id % 8 AS INT) " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(_BODIES)) + " END AS body FROM pages"
#: https fails at the network on every fourth domain, both schemes on every twentieth.
ROBOTS_TRIES = """
SELECT domain, 'https' AS scheme, CASE WHEN page_id % 4 <> 0 THEN status END AS status, CASE WHEN page_id % 4 <> 0 THEN body END AS body, CASE WHEN page_id % 4 = 0 THEN 'reset' END AS error FROM robots
UNION ALL SELECT domain, 'http', CASE WHEN page_id % 20 <> 0 THEN 200 END, CASE WHEN page_id % 20 <> 0 THEN 'User-agent: *' END, CASE WHEN page_id % 20 = 0 THEN 'refused' END FROM robots"""
LONG_BODIES = "SELECT page_id, repeat('Allow: /' || CAST(page_id % 10 AS STRING) || chr(10), CAST(page_id % 4 AS INT) * 5000 + 1) AS body FROM pages"

REQUESTS = """
SELECT event_id AS request_id, ts, user_id, 'u' || CAST(user_id AS STRING) AS ip,
       CASE event_type WHEN 'click' THEN '/trustscore' WHEN 'view' THEN '/sslcheck' WHEN 'signup' THEN '/headers' WHEN 'purchase' THEN '/robots' ELSE '/other' END AS path,
       event_id % 4 <> 0 AS paid, CAST(event_id % 3000 AS INT) AS duration_ms, event_id % 13 <> 0 AS valid, event_id % 31 = 0 AS probe_failed,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE repeat('agent ', CAST(event_id % 40 AS INT)) END AS ua
FROM events"""
CLIENTS = """
SELECT event_id AS request_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '1.1.1.' || CAST(user_id % 200 AS STRING) WHEN 1 THEN '' END AS proxy,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN ' 2.2.2.2 , 3.3.3.3' WHEN 1 THEN '' END AS forwarded, CASE WHEN event_id % 5 <> 0 THEN '9.9.9.9' END AS socket
FROM events"""
ADDRESSES = """
SELECT CASE WHEN page_id % 7 = 6 THEN '8.8.4.' || CAST(page_id % 250 AS STRING) WHEN page_id % 14 = 5 THEN '10.0.0.' || CAST(page_id % 250 AS STRING) ELSE 'h' || CAST(page_id AS STRING) || '.org' END AS host,
       CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '93.184.216.34' WHEN 1 THEN '192.168.1.1' WHEN 2 THEN 'fd00::1' WHEN 3 THEN '2606::1' END AS addr
FROM pages"""

#: Name, text, tables or earlier fixtures that it reads.
VIEWS = {
    "inputs": INPUTS, "domains": DOMAINS, "certificates": CERTIFICATES, "cert_edges": CERT_EDGES, "http": HTTP, "hops": HOPS, "robots": ROBOTS, "robots_tries": ROBOTS_TRIES,
    "long_bodies": LONG_BODIES, "requests": REQUESTS, "clients": CLIENTS, "addresses": ADDRESSES,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _reads(text: str, names) -> list[str]:
    import re

    return [n for n in names if re.search(rf"\bFROM {n}\b", text)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; nothing is registered in the session."""
    text = VIEWS[name]
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _reads(text, TABLES)} | {n: view(spark, sf_dir, n) for n in _reads(text, VIEWS) if n != name}
    for n in frames:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **frames) if frames else spark.sql(text)


def ctes(*names: str) -> str:
    """``WITH`` clauses of the fixtures, and of those that they read, for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _reads(VIEWS[n], VIEWS):
            if m != n:
                visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
