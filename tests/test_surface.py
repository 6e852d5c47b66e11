"""Streaming, SQL functions, sources, entry module."""

from __future__ import annotations

import json
import pytest
from pyspark.sql import functions as F

from sitelore.functions import sql
from sitelore.operators import traffic
from sitelore.operators.normalize_strict import normalize_strict, strict_host
from sitelore.plans import verdicts
from sitelore.plans.fixtures import view
from sitelore.sources import observations, sinks
from sitelore.streaming import traffic as stream

from .conftest import SMALL


def _drain(frame, spark, name, tmp_path, mode="append"):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name)


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """The requests as a stream, with a row far ahead that closes every window."""
    rows = view(spark, SMALL, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path_factory.mktemp("replay") / "requests")
    rows.coalesce(1).write.parquet(path)
    return rows, lambda: spark.readStream.schema(rows.schema).parquet(path)


def test_cache_stream_is_the_batch(spark, replay, tmp_path):
    rows, source = replay
    got = _drain(stream.cache_stream(source(), "user_id", 14_400), spark, "cache_s", tmp_path)
    want = traffic.cache_trace(rows, "user_id", 14_400).select("request_id", "hit")
    assert got.select("request_id", "hit").exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_rate_limit_stream_is_the_batch(spark, replay, tmp_path):
    rows, source = replay
    got = _drain(stream.rate_limit_stream(source(), "ip", most=1, window_s=3600), spark, "rate_s", tmp_path).groupBy().agg(F.sum("limited"), F.sum("requests")).first()
    batch = traffic.rate_limit(rows, "ip", 1, 3600)
    last = rows.agg(F.max("ts")).first()[0]
    closed = batch.where(F.window("ts", "3600 seconds")["end"] <= F.lit(last) - F.expr("interval 1 minute"))
    assert got[0] == closed.where("status = 429").count() and got[1] == closed.count()


def test_log_stream(spark, replay, tmp_path):
    rows, source = replay
    got = _drain(stream.request_log_stream(source().withColumn("status", F.lit(200))), spark, "log_s", tmp_path)
    assert got.count() == rows.where("path <> '/other'").count()


def test_sql_functions_are_the_operators(spark):
    sql.register(spark)
    scored = verdicts.scored_trust(spark, SMALL)
    days = F.expr("case when age_label = 'unknown' then null else age_days end")
    both = scored.withColumn("d", days).selectExpr("score", "tier", "trust_points(domain, d, has_a, has_mx, registrar) as s").selectExpr("*", "trust_tier(s) as t")
    assert both.where("s <> score or t <> tier").count() == 0
    assert spark.sql("select is_weak_cipher('RC4-MD5'), is_known_ca('DigiCert Inc'), is_private_address('10.1.1.1'), is_private_address('FD00::1'), header_grade(80)").first()[:] == (True, True, True, True, "A")
    assert spark.table("endpoints").where("paid").count() == 4 and spark.table("known_bots").count() == 24


def test_probe_source(spark):
    def probe(host):
        if host == "bad":
            raise OSError
        return (True, [f"mx.{host}"])

    spark.dataSource.register(observations.probe_source("fake_dns", "dns", "domain string, has_a boolean, mx array<string>, latency_ms int", probe, ["a", "bad", "c"], (False, None)))
    got = {r["domain"]: r["has_a"] for r in spark.read.format("fake_dns").load().collect()}
    assert got == {"a": True, "bad": False, "c": True}
    hosts = spark.createDataFrame([("a",), ("a",), ("bad",)], "host string")
    assert observations.probe_all(hosts, "dns", probe, "has_a boolean, mx array<string>", (False, None)).count() == 2


def test_json_bodies(spark):
    rows = spark.createDataFrame([('{"score": 3}', 200), ("<html>", 502)], "body string, status int")
    got = observations.read_json_bodies(rows, "body", "score int").orderBy("status").collect()
    assert got[0]["parsed"]["score"] == 3 and got[0]["raw"] is None and got[1]["raw"]["status"] == 502


def test_verdicts_keep_nulls(spark):
    body = verdicts.verdict_json(spark, SMALL).where("kind = 'trust'").select("body").first()[0]
    assert '"expires":null' in body


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_stay_narrow(spark):
    plan = verdicts.QUERIES["header_grade"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_table_functions(spark):
    sql.register(spark)
    scored = verdicts.scored_trust(spark, SMALL).withColumn("d", F.expr("case when age_label = 'unknown' then null else age_days end"))
    scored.createOrReplaceTempView("scored_trust")
    joined = spark.sql("select t.score as s, t.tier as t, f.score, f.tier from scored_trust t, lateral trust_verdict(t.domain, t.d, t.has_a, t.has_mx, t.registrar) f")
    assert joined.where("s <> score or t <> tier").count() == 0 and joined.count() == scored.count()
    certs = verdicts.scored_tls(spark, SMALL).where("error is null").select("days_remaining", "is_self_signed", "auth_error", "trusted", "score", "tier")
    certs.createOrReplaceTempView("scored_tls")
    assert spark.sql("select 1 from scored_tls t, lateral tls_verdict(t.days_remaining, t.is_self_signed, t.auth_error, t.trusted, t.score) f where f.tier <> t.tier").count() == 0


def test_header_and_crawl_table_functions(spark):
    sql.register(spark)
    headers, policy = verdicts.QUERIES["header_grade"](spark, SMALL), verdicts._policy(spark, SMALL)
    headers.createOrReplaceTempView("audited")
    policy.select("tier", "exists", "global_block", F.col("blocked").cast("int"), F.col("partial").cast("int")).createOrReplaceTempView("policies")
    graded = spark.sql("select a.grade as want, f.grade from audited a, lateral header_verdict(a.score) f")
    assert graded.where("want <> grade").count() == 0 and graded.count() == headers.count()
    tiers = spark.sql("select p.tier as want, f.tier from policies p, lateral crawl_verdict(p.exists, p.global_block, p.blocked, p.partial) f")
    assert tiers.where("want <> tier").count() == 0 and tiers.count() == policy.count()


def test_free_paths(spark):
    got = {r["path"]: json.loads(r["body"]) for r in verdicts.service_documents(spark, SMALL).collect()}
    assert set(got) == {"/", "/health", "/openapi.json"} and got["/health"] == {"status": "ok", "timestamp": "2001-06-01T00:00:00.000Z"}
    assert got["/"]["endpoints"]["GET /headers"] == {"price": "$0.003 USDC", "params": {"url": "string"}, "example": "/headers?url=https://example.com"}
    paths = got["/openapi.json"]["paths"]
    assert set(paths) == {"/", "/health", "/openapi.json", "/trustscore", "/sslcheck", "/headers", "/robots"} and set(paths["/robots"]["get"]["responses"]) == {"200", "400", "402", "429", "502"}


def test_bodies_have_all_fields(spark):
    got = {r["kind"]: json.loads(r["body"]) for r in verdicts.verdict_json(spark, SMALL).collect()}
    assert set(got["tls"]) == {"domain", "score", "maxScore", "tier", "breakdown", "warnings", "certificate", "chain", "connection", "meta"}
    assert set(got["trust"]) == {"domain", "score", "maxScore", "tier", "breakdown", "details", "meta"}
    assert set(got["headers"]) == {"url", "hostname", "grade", "score", "maxScore", "analysis", "warnings", "response", "meta"}
    assert set(got["robots"]) == {"domain", "exists", "tier", "aiFriendly", "summary", "ai", "sitemaps", "userAgents", "response", "meta"}
    assert all(set(b["meta"]) == {"checkedAt", "apiVersion", "paidWith", "cached"} for b in got.values())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("/robots", 200, '{"a":1}'), ("/robots", 502, "<html>")], "path string, status int, text string")
    got = rows.select("status", sinks.tool_result(F.col("path"), F.col("status"), F.col("text")).alias("r"), sinks.error_body(F.col("status"), F.lit("e"), F.lit("m"), F.lit("d")).alias("b")).orderBy("status").collect()
    assert (got[0]["r"]["is_error"], got[0]["r"]["text"], got[0]["b"]) == (False, '{"a":1}', None)
    assert got[1]["r"]["text"] == 'HTTP 502 from /robots:\n{"raw":"<html>","status":502}' and got[1]["b"] == '{"error":"e","domain":"d","message":"m"}'
    assert [x.count() for x in sinks.route(rows)] == [1, 1]
    url = spark.range(1).select(sinks.request_url(F.lit("https://h/"), F.lit("/robots"), "domain", F.lit("a b&c")).alias("u"), sinks.wants_html(F.lit("text/html,*/*")).alias("w")).first()
    assert url["u"] == "https://h/robots?domain=a+b%26c" and url["w"]
    sinks.write_verdicts(verdicts.QUERIES["trust_score"](spark, SMALL), str(tmp_path / "v"))
    plan = spark.read.parquet(str(tmp_path / "v")).where("tier = 'TRUSTED'")
    assert plan.count() > 0 and "PartitionFilters: [isnotnull(tier" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("raw", "host"), [("2130706433", "127.0.0.1"), ("http://0x7f.1/", "127.0.0.1"), ("https://exa%6Dple.com\\x", "example.com"), ("münchen.de", "xn--mnchen-3ya.de"), ("http://[::1]:80/", "[::1]"), ("h.com:99999", None), ("http://a b.com", None), ("http://1.2.3.4.5", None), ("", None), ("ht\ntps://a.b", "a.b")])
def test_strict_hosts(spark, raw, host):
    assert strict_host(raw) == host
    assert spark.createDataFrame([(raw,)], "r string").select(normalize_strict("r").alias("h")).first()["h"] == host


def test_hub_join_equals_a_join(spark):
    from sitelore.functions.joins import hub_join

    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    found = rows.where("k is not null and k <> 5").groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = hub_join(rows, found, ["k"], 3_000, how)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert got.columns == ["k", "v", "top"] and "n#" in plan
        want = rows.join(found.drop("n"), "k", how).select("k", "v", "top")
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_scratch_tables_go(spark):
    import os

    from sitelore import scratch

    table = scratch.written(spark.range(5).toDF("x"), "t")
    path = table._scratch.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    scratch.release(table, None)
    assert not os.path.isdir(path)
    table = scratch.written(spark.range(5).toDF("x"), "t")
    scratch.clear_scratch(spark)
    assert not os.path.isdir(table._scratch.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    from sitelore import scratch

    class Unset:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Unset()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, key, default=None: default})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
