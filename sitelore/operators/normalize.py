"""Input choice, guards, host extraction and address predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import empty, first_text

_AUTHORITY = r"^(?i)https?://(?:[^/?#@]*@)?"
_SCHEME = r"^(?i)https?://"


def pick(*names: str) -> Column:
    """The request's parameter: the first that isn't empty."""
    return first_text(*names)


def input_error(raw: Column, most: int, noun: str) -> Column:
    """The guard's error and message, null where the input passes."""
    return (
        F.when(empty(raw), F.struct(F.lit("Missing parameter").alias("error"), F.lit("Provide ?domain=example.com or ?url=https://example.com" if noun == "Domain" else "Provide ?url=https://example.com or ?domain=example.com").alias("message")))
        .when(F.length(raw) > most, F.struct(F.lit("Invalid input").alias("error"), F.lit(f"{noun} must be {most} characters or fewer").alias("message")))
    )


def host(url: Column) -> Column:
    """The lower-case host of a URL with a scheme; an IPv6 literal keeps its brackets; the empty text if there is none."""
    return F.lower(F.regexp_extract(url, _AUTHORITY + r"(\[[^\]]*\]|[^/?#:]*)", 1))


def port(url: Column) -> Column:
    """The port named, the empty text for none or for the scheme's own; null if it isn't a port."""
    text = F.regexp_extract(url, _AUTHORITY + r"(?:\[[^\]]*\]|[^/?#:]*)(?::([^/?#]*))?", 1)
    value = F.when(text == "", F.lit(-1)).otherwise(F.when(text.rlike("^[0-9]{1,6}$"), text.try_cast("int")))
    own = F.when(url.rlike(r"^(?i)https:"), 443).otherwise(80)
    return F.when((value == -1) | (value == own), F.lit("")).when(value.between(0, 65535), value.cast("string"))


def private_v4(x: Column, wide: bool = False) -> Column:
    return x.rlike(R.PRIVATE_V4_WIDE if wide else R.PRIVATE_V4)


def private_address(x: Column) -> Column:
    """Both families, as headers and robots check them."""
    return private_v4(x, wide=True) | F.lower(x).rlike(R.PRIVATE_V6)


def is_address(x: Column) -> Column:
    return x.rlike(R.IS_ADDRESS)


def url_parts(rows: DataFrame, raw: str, lower_scheme_only: bool = False) -> DataFrame:
    """``rows`` with ``_url``, ``_host`` and ``_port``: each worked out once, in a projection of its own."""
    given = F.col(raw).startswith("http") if lower_scheme_only else F.col(raw).rlike(_SCHEME)
    rows = rows.withColumn("_url", F.when(given, F.col(raw)).otherwise(F.concat(F.lit("https://"), F.col(raw))))
    return rows.withColumns({"_host": host(F.col("_url")), "_port": port(F.col("_url"))})


def extract_domain(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``domain`` for trust and certificate checks, null where it is refused.

    Only a text that begins with lower-case ``http`` is taken as having a scheme,
    so a bare ``httpbin.org`` has no host; an upper-case scheme becomes the host.
    """
    rows = url_parts(rows, raw, lower_scheme_only=True).withColumn("_name", F.regexp_replace("_host", r"^www\.", ""))
    name = F.col("_name")
    good = F.col("_url").rlike(_SCHEME) & F.col("_port").isNotNull() & ~private_v4(name) & (name != "localhost") & name.rlike(R.HOST_CHARSET) & (F.length(name) >= 4) & name.contains(".")
    return rows.withColumn("domain", F.when(good, name)).drop("_url", "_host", "_port", "_name")


def _judged(rows: DataFrame, raw: str, out: str, name: Column, parse: str, private: str, port_suffix: str) -> DataFrame:
    rows = url_parts(rows, raw).withColumn("_name", name)
    name, named = F.col("_name"), F.col("_port")
    error = (
        F.when(named.isNull() | (F.col("_host") == ""), F.lit(parse)).when(~named.isin(*R.PORTS), F.concat(F.lit("Port "), named, F.lit(" not permitted" + port_suffix)))
        .when(name == "", F.lit("Missing hostname")).when(name == "localhost", F.lit("Localhost not permitted")).when(private_address(name), F.lit(private))
        .when(~is_address(name) & ~name.rlike(R.HOST_CHARSET), F.lit("Invalid hostname"))
    )
    rows = rows.withColumn("error", error)
    return rows.withColumn(out, F.when(F.col("error").isNull() & F.col(raw).isNotNull(), F.col("_name"))).drop("_url", "_host", "_port", "_name")


def _bare(compat: bool) -> Column:
    """Loopback in brackets is refused too, unless ``compat`` asks for the rules as published."""
    return F.col("_host") if compat else F.regexp_replace("_host", r"[\[\]]", "")


def validate_url(rows: DataFrame, raw: str = "raw", compat: bool = False) -> DataFrame:
    """``rows`` with ``host`` and ``error`` for the header audit; exactly one is null."""
    return _judged(rows, raw, "host", _bare(compat), "Could not parse URL", "Private/internal addresses not permitted", " (allowed: 80, 443, 8080, 8443)")


def validate_robots_domain(rows: DataFrame, raw: str = "raw", compat: bool = False) -> DataFrame:
    """``rows`` with ``domain`` and ``error`` for the crawl policy; one leading ``www.`` is dropped."""
    return _judged(rows, raw, "domain", F.regexp_replace(_bare(compat), r"^www\.", ""), "Could not parse domain or URL", "Private addresses not permitted", "")


def cache_key(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``cache_key``: origin and path; the query is dropped, and a port that is the scheme's own."""
    rows = url_parts(rows, raw).withColumn("_path", F.regexp_extract("_url", r"^(?i)https?://[^/?#]*([^?#]*)", 1))
    scheme = F.lower(F.split_part("_url", F.lit(":"), F.lit(1)))
    named = F.when(F.col("_port") != "", F.concat(F.lit(":"), F.col("_port"))).otherwise(F.lit(""))
    key = F.concat(scheme, F.lit("://"), F.col("_host"), named, F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path")))
    return rows.withColumn("cache_key", key).drop("_url", "_host", "_port", "_path")


def client_key(proxy: Column, forwarded: Column, socket: Column) -> Column:
    """The client's address: the proxy's word, else the first forwarded, else the socket's, else ``unknown``."""
    return F.coalesce(first_text(proxy, F.regexp_replace(F.split_part(forwarded, F.lit(","), F.lit(1)), r"^\s+|\s+$", ""), socket), F.lit("unknown"))


def safe_hosts(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """``hosts(host)`` with ``safe``: a literal that isn't private, or a name with addresses none of which is.

    ``addresses(host, addr)`` is reduced to a row per host before the join.
    """
    seen = addresses.groupBy("host").agg(F.bool_or(private_address(F.col("addr"))).alias("_private"))
    literal = is_address(F.col("host"))
    safe = F.when(literal, ~private_address(F.col("host"))).otherwise(F.coalesce(~F.col("_private"), F.lit(False)))
    return hosts.join(seen, "host", "left").withColumn("safe", safe).drop("_private")
