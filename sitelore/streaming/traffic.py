"""Streaming forms of the traffic operators.

``cache_stream`` keeps one value per key, the time at which its entry was filled;
``rate_limit_stream`` keeps a count per client and window; ``request_log_stream``
is stateless.  All run in event time, so a replayed source gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import refdata as R
from ..operators import traffic


def cache_stream(requests: DataFrame, key: str, ttl_s: int, *, delay: str = "1 hour", time: str = "ts", tie: str = "request_id") -> DataFrame:
    """``request_id, key, hit, anchor_us`` of each request; state goes when the watermark passes an entry's end.

    Rows of a key within a micro-batch are taken in order of time; a row older
    than its entry is answered from it.
    """
    rows = requests.select(F.col(tie).alias("request_id"), F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    ttl = ttl_s * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).assign(t=lambda x: x["ts"].astype("datetime64[us]").astype("int64")).sort_values(["t", "request_id"])
        filled = state.get[0] if state.exists else None
        hits, anchors = [], []
        for t in frame["t"].tolist():
            hit = filled is not None and t <= filled + ttl
            if not hit:
                filled = t
            hits.append(hit)
            anchors.append(filled)
        state.update((filled,))
        state.setTimeoutTimestamp(max((filled + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": frame["request_id"], "key": group[0], "hit": hits, "anchor_us": anchors})

    return rows.groupBy("key").applyInPandasWithState(step, "request_id long, key string, hit boolean, anchor_us long", "filled long", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(requests: DataFrame, client: str, *, most: int = R.RATE_LIMIT, window_s: int = R.RATE_WINDOW_S, delay: str = "1 minute", time: str = "ts") -> DataFrame:
    """Per client and window, emitted once the watermark has passed it: requests, and how many went over."""
    rows = requests.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    counts = rows.groupBy(F.window("_t", f"{window_s} seconds").alias("w"), F.col(client).alias("client")).agg(F.count("*").alias("requests"))
    return counts.select("client", F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - most, F.lit(0)).alias("limited"))


def request_log_stream(requests: DataFrame) -> DataFrame:
    """The log as JSON lines, for a text or message sink."""
    return traffic.request_log(requests).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
