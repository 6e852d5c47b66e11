"""Probes against servers on this machine."""

from __future__ import annotations

import socket
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sitelore import refdata as R
from sitelore.sources import probes


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path.startswith("/hop"):
            n = int(self.path[4:])
            self.send_response(302 if n else 200)
            if n:
                self.send_header("Location", f"/hop{n - 1}")
            self.send_header("X-Frame-Options", "DENY")
            self.end_headers()
        elif self.path == "/away":
            self.send_response(301)
            self.send_header("Location", "ftp://x/")
            self.end_headers()
        elif self.path == "/robots.txt":
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"User-agent: *\nDisallow: /x\n")
        else:
            self.send_error(404)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def test_redirects(site, monkeypatch):
    monkeypatch.setattr(R, "PORTS", (*R.PORTS, site.split(":")[1]))
    url, status, redirects, headers = probes.http_get(f"http://{site}/hop3", safe=lambda _: True)
    assert (url, status, redirects, headers["x-frame-options"]) == (f"http://{site}/hop0", 200, 3, "DENY")
    with pytest.raises(RuntimeError, match="Too many redirects"):
        probes.http_get(f"http://{site}/hop4", safe=lambda _: True)
    with pytest.raises(PermissionError, match="ftp: scheme"):
        probes.http_get(f"http://{site}/away", safe=lambda _: True)
    with pytest.raises(PermissionError, match="private"):
        probes.http_get(f"http://{site}/hop0")


def test_robots(site):
    assert probes.robots(site, ("http",), safe=lambda _: True) == ("http", 200, "User-agent: *\nDisallow: /x\n", None)
    assert probes.robots("127.0.0.1:9", ("http",), safe=lambda _: True)[1:3] == (None, None)


def test_safe_hosts():
    assert not probes.host_is_safe("localhost") and not probes.host_is_safe("10.1.1.1") and probes.host_is_safe("93.184.216.34") and not probes.host_is_safe("[::1]")


def test_dns_answers():
    server = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    server.bind(("127.0.0.1", 0))

    def answer():
        for _ in range(3):
            message, peer = server.recvfrom(512)
            kind = struct.unpack(">H", message[-4:-2])[0]
            data = {1: socket.inet_aton("1.2.3.4"), 15: struct.pack(">H", 10) + b"\x02mx\xc0\x0c"}[kind]
            known = b"\x01a\x03org" in message
            head = message[:2] + struct.pack(">HHHHH", 0x8180 if known else 0x8183, 1, 1 if known else 0, 0, 0)
            server.sendto(head + message[12:] + (b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 60, len(data)) + data if known else b""), peer)

    threading.Thread(target=answer, daemon=True).start()
    port = server.getsockname()[1]
    assert probes.dns("a.org", "127.0.0.1", port) == (True, ["mx.a.org"])
    with pytest.raises(OSError, match="resolver code 3"):
        probes.dns_query("b.org", "A", "127.0.0.1", port)


def test_whois_fields():
    got = probes.parse_whois("Domain Name: A.ORG\r\n  Creation Date: 2001-01-02T00:00:00Z\nRegistrar: GoDaddy.com, LLC\nRegistrar: other\nRegistry Expiry Date: 2030-01-01\nempty:\n")
    assert got == {"creationDate": "2001-01-02T00:00:00Z", "registrar": "GoDaddy.com, LLC", "expirationDate": "2030-01-01"}
