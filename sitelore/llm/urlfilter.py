"""URL filter with temporal lists: every capture against the entries in force when it was fetched.

Dated entries are validity intervals of a list and a host pattern.  A capture at
time t is listed if some interval began by t and ends after it, which is to say
if the greatest end among the intervals begun by t is after t.  That maximum
makes an as-of join that splits: intervals and captures are cut into time
buckets, the maximum of earlier buckets is carried into each, and a window runs
within one (list, pattern, bucket).  So a host with a third of all captures is
spread over its buckets, a bucket of very many captures over parts that each get
the bucket's intervals, and nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hub_size

#: A pattern's captures are spread over so many parts where they meet its lists, whose few rows are repeated.
SALTS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def temporal_filter(captures: DataFrame, entries: DataFrame, *, bucket: int = 86_400) -> DataFrame:
    """``captures(url, fetched_at, ...)`` with ``host``, ``lists`` (sorted, comma-joined) and ``blocked``.

    ``entries(list_name, pattern, valid_from, valid_to)``: seconds, from inclusive,
    to exclusive, null: no end; a pattern covers its host and all hosts below.
    Entries may overlap or repeat.  Entries with a null name, pattern or start are
    void.  A capture with a null url or time is on no list; repeated captures each
    keep their row, with their own columns but those named ``host``, ``lists`` and
    ``blocked``, which are replaced; empty tables are allowed.
    """
    base = captures.withColumn("host", host_of(F.col("url")))
    pairs = base.where("host <> '' and fetched_at is not null").select("host", F.col("fetched_at").alias("t")).distinct()
    valid = entries.where("list_name is not null and pattern is not null and valid_from is not null").select(
        "list_name", F.lower("pattern").alias("pattern"), F.col("valid_from").cast("long").alias("t"), F.coalesce(F.col("valid_to").cast("long"), F.lit((1 << 63) - 1)).alias("until")
    )
    valid = valid.groupBy("list_name", "pattern", "t").agg(F.max("until").alias("until")).withColumn("bucket", F.floor(F.col("t") / bucket))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keys = valid.select("list_name", "pattern").distinct().select("*", salts)
    asked = (
        pairs.select("host", "t", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(patterns_of(F.col("host"))).alias("pattern")).join(keys, ["pattern", "salt"])
        .select("list_name", "pattern", "t", "host", F.floor(F.col("t") / bucket).alias("bucket"))
    )
    places = valid.groupBy("list_name", "pattern", "bucket").agg(F.max("until").alias("until")).unionByName(asked.select("list_name", "pattern", "bucket").distinct().withColumn("until", F.lit(None).cast("long")))
    places = places.groupBy("list_name", "pattern", "bucket").agg(F.max("until").alias("until"))
    earlier = Window.partitionBy("list_name", "pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select("list_name", "pattern", "bucket", F.max("until").over(earlier).alias("until")).where("until is not null")
    none = F.lit(None)
    place = ["list_name", "pattern", "bucket"]
    # buckets of very many captures, few by their count, are cut into parts: all tasks know them, and their intervals go to each part
    sizes = asked.groupBy(*place).agg(F.count("*").alias("n"))
    least = hub_size(sizes.agg(F.sum("n")).first()[0] or 0)
    parts = F.broadcast(sizes.where(F.col("n") >= least).select(*place, F.ceil(F.col("n") / least).cast("int").alias("parts")))
    timed = (
        valid.select(*place, "t", "until").unionByName(carried.select(*place, F.lit(-(1 << 63)).alias("t"), "until")).join(parts, place, "left")
        .select(*place, "t", "until", none.cast("string").alias("host"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    )
    rows = asked.join(parts, place, "left").select(*place, "t", none.cast("long").alias("until"), "host", F.pmod(F.xxhash64("host", "t"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")).unionByName(timed)
    begun = Window.partitionBy(*place, "part").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    active = rows.withColumn("latest", F.max("until").over(begun)).where("host is not null and latest > t")
    found = active.groupBy("host", "t").agg(F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists"))
    found = found.select(F.col("host").alias("_host"), F.col("t").alias("_t"), F.col("lists").alias("_lists"))
    out = base.join(found, (F.col("host") == F.col("_host")) & (F.col("fetched_at") == F.col("_t")), "left").drop("_host", "_t")
    return out.withColumns({"blocked": F.col("_lists").isNotNull(), "lists": F.coalesce("_lists", F.lit(""))}).drop("_lists")
