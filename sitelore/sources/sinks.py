"""Sinks: response bodies, error rows, tool results, request URLs; and writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def body(response: Column) -> Column:
    """JSON text of a nested response; nulls are written, as clients expect."""
    return F.to_json(response, {"ignoreNullFields": "false"})


def error_body(status: Column, error: Column, message: Column, domain: Column | None = None) -> Column:
    """400: error and message; 500 and 502 also the domain; null for other statuses."""
    plain = F.to_json(F.struct(error.alias("error"), message.alias("message")))
    full = plain if domain is None else F.to_json(F.struct(error.alias("error"), domain.alias("domain"), message.alias("message")))
    return F.when(status == 400, plain).when(status.isin(500, 502), full)


def route(rows: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Answers and errors, each a filter that pushes down."""
    return rows.where(F.col(status) == 200), rows.where(F.col(status) != 200)


def tool_result(path: Column, status: Column, text: Column) -> Column:
    """What a tool client is handed: ``is_error`` and the text; a body that isn't JSON is wrapped with its status."""
    parsed = F.coalesce(F.try_parse_json(text).cast("string"), F.to_json(F.struct(text.alias("raw"), status.alias("status"))))
    failed = ~status.between(200, 299)
    shown = F.when(failed, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" from "), path, F.lit(":\n"), parsed)).otherwise(parsed)
    return F.struct(failed.alias("is_error"), shown.alias("text"))


def request_url(base: Column, path: Column, name: str, value: Column) -> Column:
    """The URL that asks for one parameter; a slash that ends the base is dropped."""
    return F.concat(F.regexp_replace(base, "/$", ""), path, F.lit(f"?{name}="), F.url_encode(value))


def wants_html(accept: Column) -> Column:
    return F.coalesce(accept.contains("text/html"), F.lit(False))


def write_verdicts(verdicts: DataFrame, path: str, fmt: str = "parquet", by: str | None = "tier") -> None:
    """Partitioned by tier, so that a reader of one tier reads no other."""
    writer = verdicts.write.mode("overwrite").format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def stream_log(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The request log as JSON lines; the caller stops the query."""
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
