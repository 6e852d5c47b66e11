"""Live probes for ``observations.probe_source`` and ``probe_all``: one host or URL in, one record out.

Standard library only; each runs inside a task, under the time limits of
``refdata.TIMEOUTS``.  Records match ``observations.SCHEMAS``.
"""

from __future__ import annotations

import hashlib
import http.client
import os
import random
import re
import socket
import ssl
import struct
import tempfile
import urllib.request
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit

from .. import refdata as R

_SECONDS = {k: v / 1000 for k, v in R.TIMEOUTS.items()}
AGENT = "sitelore/1.0"

# --- registration -------------------------------------------------------------
#: Spellings of the fields that a verdict reads, lower case without blanks.
WHOIS_KEYS = {
    "creationdate": "creationDate", "created": "created", "createdon": "created", "domainregistered": "domainRegistered", "registered": "domainRegistered", "registrar": "registrar", "registrarname": "registrarName",
    "expirationdate": "expirationDate", "registryexpirydate": "expirationDate", "registrarregistrationexpirationdate": "expirationDate", "expires": "expirationDate",
}


def parse_whois(text: str) -> dict[str, str]:
    """The first value of each known field."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        name, colon, value = line.partition(":")
        key = WHOIS_KEYS.get(re.sub(r"\s+", "", name).lower())
        if colon and key and value.strip():
            found.setdefault(key, value.strip())
    return found


def _ask_whois(server: str, question: str, port: int) -> str:
    with socket.create_connection((server, port), _SECONDS["whois"]) as s:
        s.sendall(question.encode("idna") + b"\r\n")
        parts = []
        while part := s.recv(65536):
            parts.append(part)
    return b"".join(parts).decode("utf-8", "replace")


def whois(domain: str, server: str = "whois.iana.org", port: int = 43) -> tuple[dict[str, str]]:
    """The registry's record: the root server refers to it."""
    text = _ask_whois(server, domain, port)
    if referral := re.search(r"(?im)^(?:refer|whois):\s*(\S+)", text):
        text = _ask_whois(referral[1], domain, port)
    return (parse_whois(text),)


# --- names --------------------------------------------------------------------
_TYPES = {"A": 1, "MX": 15, "AAAA": 28}


def _name(message: bytes, at: int) -> tuple[str, int]:
    labels, end = [], None
    for _ in range(128):
        size = message[at]
        if size >= 0xC0:
            end = end or at + 2
            at = (size & 0x3F) << 8 | message[at + 1]
        elif size == 0:
            return ".".join(labels), end or at + 1
        else:
            labels.append(message[at + 1 : at + 1 + size].decode("ascii", "replace"))
            at += 1 + size
    raise ValueError("a loop of names")


def dns_query(host: str, kind: str, server: str | None = None, port: int = 53) -> list[str]:
    """Addresses, or mail exchanges in the resolver's order."""
    if server is None:
        with open("/etc/resolv.conf") as f:
            server = next(x.split()[1] for x in f if x.startswith("nameserver"))
    number = random.randrange(1 << 16)
    question = b"".join(bytes([len(x)]) + x for x in host.encode("idna").split(b".")) + b"\0" + struct.pack(">HH", _TYPES[kind], 1)
    with socket.socket(socket.AF_INET6 if ":" in server else socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.settimeout(_SECONDS["dns"])
        s.sendto(struct.pack(">HHHHHH", number, 0x0100, 1, 0, 0, 0) + question, (server, port))
        message = s.recv(4096)
    own, flags, questions, answers, _, _ = struct.unpack(">HHHHHH", message[:12])
    if own != number or flags & 0xF:
        raise OSError(f"resolver code {flags & 0xF}")
    at, found = 12, []
    for _ in range(questions):
        at = _name(message, at)[1] + 4
    for _ in range(answers):
        at = _name(message, at)[1]
        what, _, _, size = struct.unpack(">HHIH", message[at : at + 10])
        at += 10
        if what == _TYPES[kind]:
            data = message[at : at + size]
            found.append(socket.inet_ntoa(data) if what == 1 else socket.inet_ntop(socket.AF_INET6, data) if what == 28 else _name(message, at + 2)[0])
        at += size
    return found


def dns(host: str, server: str | None = None, port: int = 53) -> tuple[bool, list[str]]:
    """(any answer for A, mail exchanges), each failure alone."""
    try:
        dns_query(host, "A", server, port)
        has_a = True
    except (OSError, ValueError):
        has_a = False
    try:
        return has_a, dns_query(host, "MX", server, port)
    except (OSError, ValueError):
        return has_a, []


def host_is_safe(host: str) -> bool:
    """A literal that isn't private, or a name that resolves and to no private address."""
    private = lambda a: bool(re.match(R.PRIVATE_V4_WIDE, a) or re.match(R.PRIVATE_V6, a.lower()))
    if re.search(R.IS_ADDRESS, host):
        return not private(host.strip("[]"))
    try:
        found = {str(x[4][0]) for x in socket.getaddrinfo(host, None)}
    except OSError:
        return False
    return bool(found) and not any(map(private, found))


# --- certificates -------------------------------------------------------------
def _decoded(der: bytes) -> dict:
    """The fields of a certificate, by the standard library's own decoder, which reads files."""
    with tempfile.NamedTemporaryFile("w", suffix=".pem", delete=False) as f:
        f.write(ssl.DER_cert_to_PEM_cert(der))
    try:
        return ssl._ssl._test_decode_cert(f.name)
    finally:
        os.unlink(f.name)


def _names(parts) -> tuple[str | None, str | None]:
    """(CN, O), the first of each."""
    found: dict[str, str] = {}
    for part in parts or ():
        for key, value in part:
            found.setdefault(key, value)
    return found.get("commonName"), found.get("organizationName")


def tls(domain: str, port: int = 443) -> tuple:
    """A ``tls_obs`` record without its domain; a certificate that isn't trusted is read all the same."""
    error = None
    try:
        with socket.create_connection((domain, port), _SECONDS["tls"]) as s, ssl.create_default_context().wrap_socket(s, server_hostname=domain):
            pass
    except ssl.SSLCertVerificationError as e:
        error = e.verify_message
    context = ssl.create_default_context()
    context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    context.set_alpn_protocols(["http/1.1"])
    with socket.create_connection((domain, port), _SECONDS["tls"]) as s, context.wrap_socket(s, server_hostname=domain) as t:
        chain, cipher, protocol = [bytes(c) for c in t.get_unverified_chain() or ()], t.cipher(), t.version()
    if not chain:
        raise ssl.SSLError("No certificate presented")
    leaf, last = _decoded(chain[0]), _decoded(chain[-1])
    names = ",".join(f"{kind}:{value}" for kind, value in leaf.get("subjectAltName", ()))
    print_ = hashlib.sha256(chain[0]).hexdigest().upper()
    return (
        _names(leaf.get("subject")), _names(leaf.get("issuer")), _names(last.get("issuer")), leaf.get("notBefore"), leaf.get("notAfter"), names, ":".join(print_[i : i + 2] for i in range(0, 64, 2)), leaf.get("serialNumber"),
        len(chain), error is None, error, protocol, cipher and (cipher[0], cipher[1]),
    )


# --- responses ----------------------------------------------------------------
def http_hop(url: str) -> tuple[int, str | None, dict[str, str]]:
    """(status, absolute location, headers in lower case) of one request; the body isn't read."""
    parts = urlsplit(url)
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    connection = kind(parts.hostname, parts.port, timeout=_SECONDS["http"])
    try:
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": AGENT, "Accept": "*/*", "Accept-Encoding": "identity"})
        answer = connection.getresponse()
        headers: dict[str, str] = {}
        for key, value in answer.getheaders():
            headers[key.lower()] = f"{headers[key.lower()]}, {value}" if key.lower() in headers else value
        location = headers.get("location")
        return answer.status, location and urljoin(url, location), headers
    finally:
        connection.close()


def http_get(url: str, safe=host_is_safe) -> tuple[str, int, int, dict[str, str]]:
    """(final url, status, redirects, headers), each hop's host, scheme and port checked."""
    for redirects in range(R.MAX_REDIRECTS + 1):
        if not safe(urlsplit(url).hostname or ""):
            raise PermissionError(f"Refused: hostname {urlsplit(url).hostname} resolves to a private address")
        status, location, headers = http_hop(url)
        if not (300 <= status < 400 and location):
            return url, status, redirects, headers
        parts = urlsplit(location)
        if parts.scheme not in ("http", "https"):
            raise PermissionError(f"Refused redirect to {parts.scheme}: scheme")
        if str(parts.port or "") not in R.PORTS:
            raise PermissionError(f"Refused redirect to port {parts.port}")
        url = location
    raise RuntimeError(f"Too many redirects (max {R.MAX_REDIRECTS})")


def robots(domain: str, schemes: tuple[str, ...] = ("https", "http"), safe=host_is_safe) -> tuple[str, int | None, str | None, str | None]:
    """(scheme, status, body up to the cap and a byte, error): the first scheme that answers."""
    if not safe(domain.partition(":")[0]):
        raise PermissionError(f"Refused: {domain} resolves to a private address")
    error = None
    for scheme in schemes:
        try:
            request = urllib.request.Request(f"{scheme}://{domain}/robots.txt", headers={"User-Agent": AGENT, "Accept": "text/plain, */*", "Accept-Encoding": "identity"})
            with urllib.request.urlopen(request, timeout=_SECONDS["robots"]) as answer:
                return scheme, answer.status, answer.read(R.MAX_BODY_BYTES + 1).decode("utf-8", "replace"), None
        except HTTPError as e:
            return scheme, e.code, "", None
        except OSError as e:
            error = str(e)
    return schemes[-1], None, None, error
