"""Host extraction with the corner cases of the URL standard, as an Arrow-batched UDF.

``normalize.host`` is one regular expression and covers ordinary URLs inside
generated code.  This form is for inputs where it matters that backslashes count
as slashes, that tabs and line feeds vanish, that hosts may be percent-encoded or
international, and that ``2130706433`` or ``0x7f.1`` are addresses.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)")
_FORBIDDEN = re.compile("[\x00-\x20#%/:<>?@\\[\\\\\\]^|]")


def _number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part, 10)
    except ValueError:
        return None


def ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; the empty text if such a host isn't an address, null if it is a name."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (parts[-1].isdigit() or re.fullmatch("0[xX][0-9A-Fa-f]*", parts[-1])):
        return None
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return ""
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def strict_host(raw: str | None) -> str | None:
    """The host of a text, with https assumed where it has no http scheme; null where the standard's parser fails."""
    if not raw:
        return None
    text = re.sub("[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    match = _URL.match(text if re.match("(?i)https?://", text) else f"https://{text}")
    if not match:
        return None
    authority = match[2].rpartition("@")[2]
    if authority.startswith("["):
        inside, end, port = authority.partition("]")
        return f"{inside.lower()}]" if end and re.fullmatch("(:[0-9]*)?", port) else None
    name, _, port = authority.partition(":")
    if port and (not port.isdigit() or int(port) > 65535):
        return None
    name = unquote(name)
    try:
        name = name.lower() if name.isascii() else name.replace("。", ".").encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    if not name or _FORBIDDEN.search(name):
        return None
    address = ipv4(name)
    return name if address is None else address or None


@F.pandas_udf(StringType())
def normalize_strict(raw: pd.Series) -> pd.Series:
    return raw.map(strict_host, na_action="ignore")
