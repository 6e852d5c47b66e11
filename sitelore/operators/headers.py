"""Security header audit: eight analyses, total, grade and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import clipped, contains_any, empty, first_text, let, notes, staged
from . import normalize as N

#: Analysis, header, most points; in the order of totals and warnings.
ANALYSES = (
    ("hsts", "strict-transport-security", 20), ("csp", "content-security-policy", 20), ("xFrameOptions", "x-frame-options", 10), ("xContentTypeOptions", "x-content-type-options", 10),
    ("referrerPolicy", "referrer-policy", 10), ("permissionsPolicy", "permissions-policy", 10), ("coop", "cross-origin-opener-policy", 10), ("serverDisclosure", "server", 10),
)


def _analysis(present: Column, value: Column, score: Column, most: int, own_notes: Column) -> Column:
    return F.struct(present.alias("present"), value.alias("value"), score.cast("int").alias("score"), F.lit(most).alias("maxScore"), own_notes.alias("notes"))


def _of(value: Column, score: Column, most: int, *parts: Column, shown: Column | None = None) -> Column:
    """An empty header counts as missing."""
    absent = _analysis(F.lit(False), F.lit(None).cast("string"), F.lit(0), most, F.array(F.lit("missing")))
    return F.when(empty(value), absent).otherwise(_analysis(F.lit(True), value if shown is None else shown, score, most, notes(*parts)))


def hsts(v: Column) -> Column:
    age = F.coalesce(F.regexp_extract(v, "(?i)max-age=([0-9]+)", 1).try_cast("double"), F.lit(0.0))
    sub = v.rlike("(?i)includeSubDomains")
    score = F.lit(8) + F.when(age >= 31536000, 7).when(age >= 15768000, 4).otherwise(0) + F.when(sub, 3).otherwise(0) + F.when(v.rlike("(?i)preload"), 2).otherwise(0)
    return _of(v, score, 20, F.when(age < 15768000, "max_age_too_short").when(age < 31536000, "max_age_short"), F.when(~sub, "missing_includeSubDomains"))


def csp(v: Column) -> Column:
    inline, evaluated = v.rlike("(?i)unsafe-inline"), v.rlike("(?i)unsafe-eval")
    wild = v.contains("*") & ~v.rlike("(?i)strict-dynamic")
    score = (
        F.lit(10) - F.when(inline, 4).otherwise(0) - F.when(evaluated, 4).otherwise(0) + F.when(wild, 0).otherwise(5)
        + F.when(v.rlike("(?i)default-src"), 3).otherwise(0) + F.when(v.rlike(r"(?i)frame-ancestors\s+(none|'self')"), 2).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(20), score))
    return _of(v, score, 20, F.when(inline, "uses_unsafe_inline"), F.when(evaluated, "uses_unsafe_eval"), F.when(wild, "wildcard_source"), shown=clipped(v, 200))


def _ranked(v: Column, read: Column, ranks: dict[str, int], most: int = 10) -> Column:
    score, weak = F.lit(3), F.lit("weak_value")
    for value, points in ranks.items():
        score, weak = F.when(read == value, points).otherwise(score), F.when(read == value, F.lit(None).cast("string")).otherwise(weak)
    return _of(v, score, most, weak)


def x_frame_options(v: Column) -> Column:
    return _ranked(v, F.upper(v), {"DENY": 10, "SAMEORIGIN": 8})


def x_content_type_options(v: Column) -> Column:
    return _ranked(v, F.lower(v), {"nosniff": 10})


def referrer_policy(v: Column) -> Column:
    low = F.lower(v)
    good, unsafe = contains_any(low, R.REFERRER_POLICIES), low.contains("unsafe-url")
    return _of(v, F.when(good, 10).when(unsafe, 0).otherwise(5), 10, F.when(~good & unsafe, "unsafe_policy"))


def permissions_policy(v: Column) -> Column:
    return _of(v, F.lit(10), 10, shown=clipped(v, 150))


def coop(v: Column) -> Column:
    return _ranked(v, F.lower(v), {"same-origin": 10, "same-origin-allow-popups": 7})


def server_disclosure(server: Column, powered: Column) -> Column:
    """Starts full and loses points; present if either header is."""
    named, versioned, by = ~empty(server), server.rlike(r"[0-9]+\.[0-9]+"), ~empty(powered)
    score = F.greatest(F.lit(0), F.lit(10) - F.when(named & versioned, 5).when(named, 2).otherwise(0) - F.when(by, 5).otherwise(0))
    own = notes(F.when(named & versioned, "server_version_disclosed").when(named, "server_disclosed"), F.when(by, "x_powered_by_disclosed"))
    return _analysis(named | by, first_text(server, powered), score, 10, own)


def grade(total: Column) -> Column:
    return F.when(total >= 90, "A+").when(total >= 80, "A").when(total >= 70, "B").when(total >= 50, "C").when(total >= 30, "D").otherwise("F")


def audit(observed: DataFrame, headers: str = "headers") -> DataFrame:
    """``observed`` with a map of headers: one struct column per analysis, ``score``, ``max_score``, ``grade`` and ``warnings``.

    Narrow: everything stays in the row's own stage.
    """
    low = F.transform_keys(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    rows = observed.withColumn("_h", low)
    get = lambda name: F.try_element_at(F.col("_h"), F.lit(name))
    plain = (hsts, csp, x_frame_options, x_content_type_options, referrer_policy, permissions_policy, coop)
    built = {name: f(get(header)) for f, (name, header, _) in zip(plain, ANALYSES, strict=False)}
    built["serverDisclosure"] = server_disclosure(get("server"), get("x-powered-by"))
    rows = rows.withColumns(built).drop("_h")
    names = [a[0] for a in ANALYSES]
    total = sum((F.col(n)["score"] for n in names), F.lit(0)).cast("int")
    own = lambda n: F.when(~F.col(n)["present"], F.array(F.lit(f"missing_{n}"))).otherwise(F.transform(F.filter(F.col(n)["notes"], lambda x: x != "missing"), lambda x: F.concat(F.lit(f"{n}:"), x)))
    rows = rows.withColumns({"score": total, "max_score": sum((F.col(n)["maxScore"] for n in names), F.lit(0)).cast("int"), "warnings": F.concat(*map(own, names))})
    return rows.withColumn("grade", grade(F.col("score")))


def long_form(audited: DataFrame, key: str) -> DataFrame:
    """A row per analysis: key, analysis, present, value, score, max_score, notes."""
    entries = F.array(*[F.struct(F.lit(n).alias("analysis"), F.col(n).alias("a")) for n, _, _ in ANALYSES])
    rows = audited.select(key, F.explode(entries).alias("e"))
    return rows.select(key, "e.analysis", "e.a.present", "e.a.value", "e.a.score", F.col("e.a.maxScore").alias("max_score"), "e.a.notes")


def resolved(base: Column, location: Column) -> Column:
    """The URL that a ``Location`` means at ``base``: absolute, with another host or path, relative to the folder, or only a query or mark.

    Scheme and host are in lower case, a port that is the scheme's own and dot segments are gone, an empty path is ``/``.
    """
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_extract(bare, "^(.*/)", 1))
    whole = (
        F.when(location.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), location).when(location.startswith("//"), F.concat(F.split_part(base, F.lit(":"), F.lit(1)), F.lit(":"), location))
        .when(location.startswith("/"), F.concat(origin, location)).when(location.startswith("?"), F.concat(bare, location))
        .when(location.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), location)).otherwise(F.concat(folder, location))
    )
    return let(whole, _normal)


def _normal(url: Column) -> Column:
    head = F.regexp_replace(F.lower(F.regexp_extract(url, r"^((?i)https?://[^/?#]*)", 1)), r"^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2")
    path, rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)),
    )
    plain = F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))).otherwise(path)
    return F.when(head == "", url).otherwise(F.concat(head, F.when(plain == "", F.lit("/")).otherwise(plain), rest))


def follow_redirects(hops: DataFrame, starts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """``hops(url, status, location)``: start, final url, redirects and error of a walk from each different ``starts(url)``.

    A hop with a 3xx status and a location, which may be relative, leads on; the
    target must have an allowed scheme and port, and, as the start, a host that isn't
    private: by its address, by name, or, with ``hosts(host, safe)``, by what its
    name resolves to (a name that isn't listed doesn't).  After three redirects a
    fourth is too many.  Each step is a left join with the hops, one by URL (the
    least status and location), so there is no bound on the number of walks.
    """
    one = hops.groupBy("url").agg(F.min(F.struct("status", "location")).alias("_hop"))
    walk = starts.select(F.col("url").alias("start")).distinct().select("start", F.col("start").alias("url"), F.lit(0).alias("redirects"), F.lit(None).cast("string").alias("error"))
    for step in range(R.MAX_REDIRECTS + 1):
        walk = staged(walk, {"_host": F.regexp_replace(N.host(F.col("url")), r"[\[\]]", "")})
        unsafe = (F.col("_host") == "localhost") | N.private_address(F.col("_host"))
        if hosts is not None:
            walk = walk.join(hosts.select(F.col("host").alias("_host"), F.col("safe").alias("_safe")), "_host", "left")
            unsafe = unsafe | (~N.is_address(F.col("_host")) & ~F.coalesce("_safe", F.lit(False)))
        refused = F.concat(F.lit("Refused: hostname "), F.col("_host"), F.lit(" resolves to a private address"))
        walk = walk.select("start", "url", "redirects", F.coalesce("error", F.when((F.col("redirects") == step) & unsafe, refused)).alias("error"))
        joined = walk.join(one, "url", "left")
        leads = F.col("error").isNull() & (F.col("redirects") == step) & F.col("_hop.status").between(300, 399) & (F.coalesce("_hop.location", F.lit("")) != "")
        joined = staged(joined, {"_to": F.when(leads, resolved(F.col("url"), F.col("_hop.location")))})
        joined = staged(joined, {"_port": N.port(F.col("_to")), "_named": N.host(F.col("_to")) != ""})
        to, port = F.col("_to"), F.col("_port")
        error = (
            F.when(~to.rlike("^(?i)https?:"), F.concat(F.lit("Refused redirect to "), F.regexp_extract(to, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.lit(" scheme")))
            .when(~F.col("_named") | port.isNull(), "Invalid redirect Location header").when(~port.isin(*R.PORTS), F.concat(F.lit("Refused redirect to port "), port))
            .when(F.lit(step == R.MAX_REDIRECTS), f"Too many redirects (max {R.MAX_REDIRECTS})")
        )
        walk = joined.select("start", F.coalesce(to, F.col("url")).alias("url"), (F.col("redirects") + F.when(to.isNotNull(), 1).otherwise(0)).cast("int").alias("redirects"), F.when(to.isNotNull(), error).otherwise(F.col("error")).alias("error"))
    return walk.select("start", F.col("url").alias("final_url"), "redirects", "error")
