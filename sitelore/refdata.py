"""Reference data: lists and prices that verdicts depend on.  Fixed values, in their natural order."""

from __future__ import annotations

TRUSTED_TLDS = (".com", ".org", ".net", ".io", ".dev", ".ai")
RISKY_TLDS = (".xyz", ".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".click")

#: Substrings of established registrars' names; the blank after "csc" counts.
REGISTRARS = ("godaddy", "namecheap", "cloudflare", "google", "amazon", "name.com", "network solutions", "markmonitor", "csc ", "tucows", "enom", "dynadot", "porkbun", "gandi")

#: Substrings of trusted certificate authorities' names.
AUTHORITIES = (
    "let's encrypt", "digicert", "globalsign", "sectigo", "comodo", "godaddy", "amazon", "google trust", "cloudflare", "entrust",
    "thawte", "geotrust", "rapidssl", "verisign", "buypass", "identrust", "actalis", "zerossl",
)

#: Fragments of weak ciphers' names that can match.
WEAK_CIPHERS = ("rc4", "des", "md5", "null", "export", "3des")

REFERRER_POLICIES = ("no-referrer", "same-origin", "strict-origin", "strict-origin-when-cross-origin")

#: Crawlers whose rules are reported.
BOTS = (
    "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "anthropic-ai", "Claude-Web", "Google-Extended", "FacebookBot", "Meta-ExternalAgent", "PerplexityBot", "YouBot", "cohere-ai",
    "Bytespider", "Diffbot", "Omgilibot", "Applebot-Extended", "ImagesiftBot", "Amazonbot", "Bingbot", "CCBot", "AI2Bot", "Timpibot", "magpie-crawler", "SemrushBot-OCOB",
)

#: Ports that a URL may name; the empty text is the scheme's own.
PORTS = ("", "80", "443", "8080", "8443")

#: Path, price in dollars, seconds that a response is cached.
ENDPOINTS = (("/trustscore", "0.003", 3600), ("/sslcheck", "0.002", 21600), ("/headers", "0.003", 14400), ("/robots", "0.002", 43200))
PAID_PATHS = tuple(e[0] for e in ENDPOINTS)
#: What every response says of itself.
API_VERSION, PAID_WITH = "1.0", "x402/USDC"
FREE_PATHS = ("/", "/health", "/openapi.json")

#: Whole hosts that are labels and digits: 3 to 253 characters.
HOST_CHARSET = r"^[a-zA-Z0-9][a-zA-Z0-9\-.]{1,251}[a-zA-Z0-9]$"
PRIVATE_V4 = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.0\.0\.0)"
PRIVATE_V4_WIDE = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.0\.0\.0|169\.254\.)"
PRIVATE_V6 = r"^(::1|fc00:|fd00:|fe80:)"
IS_ADDRESS = r"^[0-9.]+$|:"

MAX_REDIRECTS, MAX_BODY_BYTES = 3, 102_400
RATE_LIMIT, RATE_WINDOW_S = 60, 60
CACHE_ENTRIES = 1_000
#: Milliseconds by probe.
TIMEOUTS = {"whois": 5_000, "dns": 4_000, "host_check": 3_000, "tls": 8_000, "http": 8_000, "robots": 8_000}
