"""Traffic around the verdicts: response cache, rate limit, request log, routing, timeouts."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import refdata as R
from ..functions.joins import hub_join
from ..functions.text import base64_line, clipped


def _misses(times: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, _m, _first): the times that miss, of ``times(key, _t, _first)``, which have a key's different times.

    A miss fills the entry and the next one is the first time after it ran out: a
    recurrence over a key's times in order.  They stream through their task, a
    batch at a time, and only the last miss is held, so memory is bounded and time
    linear for a key of any size; within a batch the search jumps from miss to miss.
    """
    ordered = times.repartition(key).sortWithinPartitions(key, "_t").select(key, "_t", "_first")
    schema = ordered.select(key, F.col("_t").alias("_m"), "_first").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last = None
        for batch in batches:
            found, keys, t = [], batch.column(0), batch.column(1).to_numpy()
            codes = keys.dictionary_encode(null_encoding="encode")
            change = np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(t)], strict=True):
                name = keys[a].as_py() if b > a else None
                last, last_key, at = (last if name == last_key and last is not None else None), name, a
                while b > a:
                    at = at if last is None else a + int(np.searchsorted(t[a:b], last + ttl, "right"))
                    if at >= b:
                        break
                    found.append(at)
                    last = int(t[at])
            if found:
                yield pa.RecordBatch.from_arrays(batch.take(pa.array(found)).columns, names=[key, "_m", "_first"])

    return ordered.mapInArrow(run, schema)


def cache_trace(requests: DataFrame, key: str, ttl_s: int, time: str = "ts", tie: str = "request_id") -> DataFrame:
    """``requests`` with ``hit`` and ``anchor`` (the time of the miss that filled the entry).

    A hit needs ``now <= filled + ttl``; hits don't extend an entry.  Only a key's
    different times and their least ``tie`` go through the recurrence.  Misses are
    more than a ttl apart, so a slot of a ttl's length has at most one: a request's
    anchor is its slot's miss, or the last one before the slot, found by an
    equality join with the slots, of which a key has no more than its span of time
    holds.  Slots of very many requests are sent to them.  Null keys are one key;
    requests without a time are dropped.
    """
    ttl = ttl_s * 1_000_000
    spare = F.lit("").cast(requests.schema[key].dataType) if isinstance(requests.schema[key].dataType, StringType) else F.lit(0).cast(requests.schema[key].dataType)
    slot = lambda c: F.floor(F.col(c) / F.lit(ttl)).cast("long")
    rows = requests.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).where("_t is not null")
    rows = rows.withColumns({"_slot": slot("_t"), "_k": F.coalesce(key, spare), "_null": F.col(key).isNull()})
    by = ["_k", "_null", "_slot"]
    times = rows.groupBy(key, "_t").agg(F.min(tie).alias("_first"))
    misses = _misses(times, key, ttl).select(F.coalesce(key, spare).alias("_k"), F.col(key).isNull().alias("_null"), slot("_m").alias("_slot"), "_m", "_first")
    slots = rows.groupBy(*by).agg(F.count("*").alias("n")).join(misses, by, "left")
    earlier = Window.partitionBy("_k", "_null").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.max("_m").over(earlier))
    found = hub_join(rows, slots, by, requests.count())
    anchor = F.when(F.col("_t") >= F.col("_m"), F.col("_m")).otherwise(F.col("_before"))
    hit = (F.col("_t") > anchor) | (F.col(tie) != F.col("_first"))
    return found.withColumns({"hit": hit, "anchor": F.timestamp_micros(anchor)}).select(*requests.columns, "hit", "anchor")


def fifo_trace(requests: DataFrame, key: str, ttl_s: int, most: int = R.CACHE_ENTRIES, time: str = "ts", tie: str = "request_id", cache: str | None = None) -> DataFrame:
    """The cache with its bound: after an insertion beyond ``most`` entries the first inserted goes; an entry that ran out goes when it is read.

    The order is that of all requests to a cache, so each cache is one sequential
    pass by definition, which holds its entries alone: one task for each value of
    ``cache`` (an endpoint, say), or one for all.  ``cache_trace`` is the parallel
    form without the bound.  Null keys and caches count as one.
    """
    own = F.lit("") if cache is None else F.coalesce(F.col(cache).cast("string"), F.lit(""))
    narrow = requests.select(own.alias("cache"), F.col(tie).alias("request_id"), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    ordered = (narrow.repartition(1) if cache is None else narrow.repartition("cache")).sortWithinPartitions("cache", "t", "request_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: OrderedDict[str, int] = OrderedDict()
        now_in = None
        for frame in frames:
            hits = []
            for where, name, now in zip(frame["cache"], frame["key"], frame["t"], strict=True):
                if where != now_in:
                    entries, now_in = OrderedDict(), where
                hit = name in entries and now <= entries[name]
                if not hit:
                    entries.pop(name, None)
                    entries[name] = now + ttl_s * 1_000_000
                    if len(entries) > most:
                        entries.popitem(last=False)
                hits.append(hit)
            yield pd.DataFrame({"request_id": frame["request_id"], "key": frame["key"], "hit": hits})

    return ordered.mapInPandas(run, "request_id long, key string, hit boolean")


def rate_limit(requests: DataFrame, client: str, most: int = R.RATE_LIMIT, window_s: int = R.RATE_WINDOW_S, time: str = "ts", tie: str = "request_id") -> DataFrame:
    """``requests`` with ``status`` 200 or 429: the first ``most`` of a client in each window pass (windows aligned to the epoch)."""
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (window_s * 1_000_000))
    place = F.row_number().over(Window.partitionBy(client, "_slot").orderBy(time, tie))
    return requests.withColumn("_slot", slot).withColumn("status", F.when(place <= most, 200).otherwise(429).cast("int")).drop("_slot")


def request_log(requests: DataFrame) -> DataFrame:
    """The log record of requests on paid paths."""
    return requests.where(F.col("path").isin(*R.PAID_PATHS)).select(
        F.lit("request").alias("evt"), "request_id", "path", "status", (F.col("status") == 200).alias("settled"), "ip", clipped("ua", 120, "").alias("ua"), "duration_ms", "ts"
    )


def route_status(requests: DataFrame) -> DataFrame:
    """``requests(path, paid, limited, valid, probe_failed)`` with the status that the chain of handlers ends in."""
    paid_path = F.col("path").isin(*R.PAID_PATHS)
    status = (
        F.when(F.col("path").isin(*R.FREE_PATHS), 200).when(paid_path & ~F.col("paid"), 402).when(F.col("limited"), 429).when(~paid_path, 404)
        .when(~F.col("valid"), 400).when(F.col("probe_failed"), F.when(F.col("path") == "/trustscore", 500).otherwise(502)).otherwise(200)
    )
    return requests.withColumn("status", status.cast("int"))


def payment_header(status: Column, version: Column, present: Column, body: Column) -> Column:
    """The encoded body of a 402 of version 2 that has no header yet, else null."""
    return F.when((status == 402) & (version == 2) & ~present, base64_line(body))


def within(latency_ms: Column, probe: str, value: Column) -> Column:
    """The probe's value, null where it took too long."""
    return F.when(latency_ms <= R.TIMEOUTS[probe], value)


def endpoints(spark) -> DataFrame:
    """The catalog of paid and free paths."""
    rows = [(p, price, ttl, True) for p, price, ttl in R.ENDPOINTS] + [(p, "0.000", 0, False) for p in R.FREE_PATHS]
    return spark.createDataFrame(rows, "path string, price string, cache_seconds int, paid boolean").withColumn("price", F.col("price").cast("decimal(6,3)"))
