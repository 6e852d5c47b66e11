"""Crawl policy: robots.txt parsing, rules of known crawlers, tier.

Everything stays in the row that holds the body, as functions over arrays of its
lines: no shuffle, whatever the number of domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.text import let, number_prefix, staged, trimmed

GROUP = "struct<userAgent: string, allow: array<string>, disallow: array<string>, crawlDelay: double>"


def truncated_body(body: Column) -> tuple[Column, Column]:
    """(the first 102,400 bytes, whether there were more); a character cut in two becomes a replacement mark or goes."""
    more = F.octet_length(body) > R.MAX_BODY_BYTES
    return F.when(more, F.decode(F.substring(F.encode(body, "utf-8"), 1, R.MAX_BODY_BYTES), "utf-8")).otherwise(body), more


def choose_source(observed: DataFrame) -> DataFrame:
    """``observed(domain, scheme, status, body, error)``: https if it answered at all, else http; ``error`` if neither did."""
    rank = F.when(F.col("scheme") == "https", 0).otherwise(1)
    best = F.struct(F.col("error").isNotNull().alias("failed"), F.when(F.col("error").isNull(), rank).otherwise(-rank).alias("rank"), "scheme", "status", "body", "error")
    return observed.groupBy("domain").agg(F.min(best).alias("b")).select("domain", "b.scheme", "b.status", "b.body", "b.error")


def exists(status: Column) -> Column:
    return F.coalesce(status == 200, F.lit(False))


def lines_of(body: Column) -> Column:
    """(directive, value, has a colon, is blank) of each line, comments dropped."""
    def line(text: Column) -> Column:
        colon = F.instr(text, ":")
        return F.struct(
            F.lower(trimmed(F.substring(text, F.lit(1), F.greatest(colon - 1, F.lit(0))))).alias("directive"), trimmed(F.substring(text, colon + 1, F.length(text))).alias("value"), (colon > 0).alias("ruled"), (text == "").alias("blank")
        )

    return F.transform(F.transform(F.split(body, "\\r?\\n", -1), lambda raw: trimmed(F.regexp_replace(raw, "(?s)#.*$", ""))), line)


def _groups(rules: Column) -> Column:
    """Groups in order: each user-agent line opens one, the rules up to the next are its own, rules before the first are dropped.

    ``rules`` is read by index and in slices that don't overlap: linear in the lines, where a fold would copy what it has at each step.
    """
    opens = F.filter(F.transform(rules, lambda x, i: F.when(x["directive"] == "user-agent", i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(opens, F.lit(2), F.size(opens)), F.array(F.size(rules)))

    def group(start: Column, end: Column) -> Column:
        own = F.transform(F.when(end - start > 1, F.sequence(start + 1, end - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(rules, i))
        values = lambda own, name: F.transform(F.filter(own, lambda x: x["directive"] == name), lambda x: x["value"])
        return let(own, lambda own: F.struct(
            F.get(rules, start)["value"].alias("userAgent"), values(own, "allow").alias("allow"), values(own, "disallow").alias("disallow"),
            F.try_element_at(F.filter(F.transform(F.filter(own, lambda x: x["directive"] == "crawl-delay"), lambda x: number_prefix(x["value"])), lambda n: n.isNotNull()), F.lit(-1)).alias("crawlDelay"),
        ))

    return F.when(F.size(opens) > 0, F.zip_with(opens, ends, group)).otherwise(F.array().cast(f"array<{GROUP}>")).cast(f"array<{GROUP}>")


def parse(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` with ``groups``, ``sitemaps``, ``raw_lines`` and ``has_errors``: the body is taken apart once, in a stage of its own."""
    own = [c for c in rows.columns if c not in ("groups", "sitemaps", "raw_lines", "has_errors")]
    lined = staged(rows.select(*own), {"_lines": lines_of(F.coalesce(F.col(body), F.lit("")))})
    lined = lined.withColumn("_rules", F.filter("_lines", lambda x: x["ruled"] & x["directive"].isin("user-agent", "allow", "disallow", "crawl-delay")))
    return staged(lined, {
        "groups": _groups(F.col("_rules")),
        "sitemaps": F.transform(F.filter("_lines", lambda x: x["ruled"] & (x["directive"] == "sitemap") & (x["value"] != "")), lambda x: x["value"]),
        "raw_lines": F.size("_lines").cast("long"),
        "has_errors": F.exists("_lines", lambda x: ~x["blank"] & ~x["ruled"]),
    }).drop("_lines", "_rules")


def shared_rules(groups: Column) -> Column:
    """The conventional reading of agents in a row: one without rules of its own has those of the next that has some."""
    bare = lambda g: (F.size(g["allow"]) == 0) & (F.size(g["disallow"]) == 0) & g["crawlDelay"].isNull()
    # the place of the group whose rules each has, by a fold over places alone, from the last
    places = F.aggregate(
        F.reverse(F.transform(groups, lambda g, i: F.when(~bare(g), i))), F.struct(F.lit(None).cast("int").alias("next"), F.lit("").alias("run")),
        lambda acc, i: let(F.coalesce(i, acc["next"]), lambda own: F.struct(own.alias("next"), F.concat(F.coalesce(own.cast("string"), F.lit("-1")), F.lit(","), acc["run"]).alias("run"))), lambda acc: F.split(F.rtrim(F.regexp_replace(acc["run"], ",$", "")), ","),
    )

    def own(g: Column, place: Column) -> Column:
        after = F.get(groups, place.cast("int"))
        rules = F.when(bare(g) & after.isNotNull(), after).otherwise(g)
        return F.struct(g["userAgent"].alias("userAgent"), rules["allow"].alias("allow"), rules["disallow"].alias("disallow"), rules["crawlDelay"].alias("crawlDelay"))

    return F.when(F.size(groups) > 0, F.zip_with(groups, places, own)).otherwise(groups).cast(f"array<{GROUP}>")


def _blocks_root(rules: Column, strict: bool = False) -> Column:
    return F.exists(rules, lambda d: d == "/" if strict else d.isin("/", ""))


def flags(groups: Column, strict: bool = False) -> tuple[Column, Column]:
    """(global block, global allow) of the first group named ``*``; an empty ``Disallow`` sets both, unless ``strict``."""
    star = F.get(F.filter(groups, lambda g: g["userAgent"] == "*"), F.lit(0))
    block = F.coalesce(_blocks_root(star["disallow"], strict), F.lit(False))
    return block, F.coalesce(F.forall(star["disallow"], lambda d: d == ""), F.lit(True))


def policies(groups: Column, global_block: Column, strict: bool = False) -> Column:
    """The rules of the known crawlers, in order: the first group of their name, any case, else the global block."""
    no_rules = F.array().cast("array<string>")

    def policy(own: Column, place: Column) -> Column:
        root = _blocks_root(own["disallow"], strict)
        return F.struct(
            F.get(F.array(*[F.lit(b) for b in R.BOTS]), place).alias("bot"),
            F.when(own.isNull(), global_block).otherwise(root & (F.size(own["allow"]) == 0)).alias("blocked"),
            F.when(own.isNull(), F.lit(False)).otherwise(~root & F.exists(own["disallow"], lambda d: d != "")).alias("partial"),
            F.struct(F.coalesce(own["allow"], no_rules).alias("allow"), F.coalesce(own["disallow"], no_rules).alias("disallow")).alias("rules"),
        )

    def looked_up(agents: Column) -> Column:
        return F.transform(F.array(*[F.lit(b.lower()) for b in R.BOTS]), lambda bot: F.get(groups, (F.array_position(agents, bot) - 1).cast("int")))

    return F.transform(let(F.transform(groups, lambda g: F.lower(g["userAgent"])), looked_up), policy)


def tier(there: Column, global_block: Column, blocked: Column, partial: Column) -> tuple[Column, Column]:
    """(tier, whether it is friendly to crawlers)."""
    n = len(R.BOTS)
    name = (
        F.when(~there, "NO_ROBOTS_TXT").when(global_block & (blocked == n), "BLOCKED_ALL").when(blocked > n / 2, "BLOCKED_AI")
        .when((blocked > 0) | (partial > n / 3), "SELECTIVE").otherwise("OPEN")
    )
    return name, ~name.isin("BLOCKED_ALL", "BLOCKED_AI")


def crawl_policy(observed: DataFrame, strict: bool = False) -> DataFrame:
    """``observed(domain, status, body)``: parse, flags, policies, counts and tier; null parts where there is no robots.txt.

    The default has each user-agent line open a group of its own and an empty
    ``Disallow`` block; ``strict`` reads both as is conventional: agents in a row
    share rules, and an empty ``Disallow`` allows all.
    """
    there = exists(F.col("status"))
    body, more = truncated_body(F.when(there, F.col("body")))
    rows = parse(observed.withColumns({"exists": there, "truncated": F.coalesce(more, F.lit(False)), "body": body}))
    if strict:
        rows = staged(rows, {"groups": shared_rules(F.col("groups"))})
    block, allow = flags(F.col("groups"), strict)
    rows = rows.withColumns({"global_block": block, "global_allow": allow})
    rows = staged(rows, {"policies": policies(F.col("groups"), F.col("global_block"), strict)})
    count = lambda name: F.size(F.filter("policies", lambda p: p[name])).cast("long")
    rows = rows.withColumns({"blocked": count("blocked"), "partial": count("partial")})
    name, friendly = tier(F.col("exists"), F.col("global_block"), F.col("blocked"), F.col("partial"))
    rows = rows.withColumns({"tier": name, "friendly": friendly})
    only = ("raw_lines", "has_errors", "truncated", "global_block", "global_allow", "policies", "blocked", "partial")
    empty_lists = {"groups": f"array<{GROUP}>", "sitemaps": "array<string>"}
    return rows.withColumns({c: F.when(F.col("exists"), F.col(c)) for c in only} | {c: F.when(F.col("exists"), F.col(c)).otherwise(F.array().cast(t)) for c, t in empty_lists.items()})
