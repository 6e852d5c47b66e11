"""Chat formatting, URL filter and the pipeline."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitelore.llm import chatfmt, decontam, neardup, pii, queries, toxicity, urlfilter

from ..conftest import SMALL
from .conftest import EDGES

TURNS = "conv_id long, turn long, role string, text string"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", "<|im_end|>", None]), st.text(alphabet="\\<|>\nnab", max_size=12) | st.sampled_from(["<|im_start|>", "<|im_end|>\n", None])), min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], TURNS)
    got = chatfmt.format_chats(rows).select("formatted", chatfmt.parse(F.col("formatted")).alias("turns"), chatfmt.loss_text(F.col("segments")).alias("loss"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined")).first()
    assert [tuple(t) for t in got["turns"]] == [(r or "", t or "") for r, t in turns]
    assert got["loss"] == "".join(t or "" for r, t in turns if r == "assistant")
    assert got["joined"] == got["formatted"]
    assert got["formatted"].count("<|im_start|>") == got["formatted"].count("<|im_end|>") == len(turns)


ORDERS = [(["user", "assistant"], "assistant", 0), (["system", "user"], "user", 0), (["assistant"], "assistant", 1), (["user", "user"], "user", 1), (["user", "assistant", "tool", "tool", "assistant"], "assistant", 0), (["user", "system"], "system", 1), (["user", "narrator", "assistant"], "assistant", 2)]


@pytest.mark.parametrize(("roles", "state", "misplaced"), ORDERS)
def test_turn_order(spark, roles, state, misplaced):
    got = chatfmt.format_chats(spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], TURNS)).first()
    assert (got["state"], got["misplaced"], got["valid"]) == (state, misplaced, misplaced == 0 and state == "assistant")


def test_a_long_conversation(spark):
    """More turns than a fold's chunk, in linear time."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").when(F.col("id") == 777, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    began = time.monotonic()
    got = chatfmt.format_chats(rows).select("n_turns", "state", "valid", "misplaced", F.size(F.filter("segments", lambda s: s["loss"])).alias("loss")).first()
    assert tuple(got) == (n, "assistant", False, 2, n // 2 - 1)
    assert time.monotonic() - began < 30


def test_op6_comes_through_its_machine(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b")], TURNS)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op6_chat_format(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    machine = [line for line in plan.split("\n") if "aggregate(sequence(" in line]
    assert len(machine) == 1 and all(f"{k}," in machine[0] or f"{k}]" in machine[0] for k in chatfmt.CHAT.table)
    assert plan.count("run#") > 1 and "zip_with(rows" in plan  # the segments follow the machine's run
    got = {r["conv_id"]: (r["state"], r["valid"], r["misplaced"], r["loss_chars"]) for r in out.collect()}
    assert got == {1: ("assistant", False, 1, 1), 2: ("assistant", True, 0, 1), -1: ("assistant", True, 0, len("<|im_end|><|im_start|>assistant ok"))}


def test_chat_edges(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (2, 1, "user", "b"), (2, 1, "user", "b"), (2, 0, "user", ""), (3, 0, "assistant", "y" * 300_000)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("segments", F.lit(1)).withColumn("rows", F.lit("x"))
    got = {r["conv_id"]: r for r in chatfmt.format_chats(frame).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {None: 2, 2: 3, 3: 1}
    assert chatfmt.format_chats(frame.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = chatfmt.format_chats(spark.createDataFrame([(1, 1, "user", "x")], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.replace("ArrowRDD", ""))


@pytest.mark.parametrize("hub", [256, 7])
def test_url_filter_brute_force(spark, monkeypatch, hub):
    """Also where each bucket of a few captures is cut into parts."""
    monkeypatch.setattr(urlfilter, "hub_size", lambda size: hub)
    rng = random.Random(6)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "aa.com", "x.org", "", "com"]
    captures = [(i, None if h == "" else f"https://u@{h.upper()}:8080/p", None if rng.random() < 0.02 else rng.randrange(0, 400_000)) for i in range(400) for h in [rng.choice(hosts)]] + [(0, "https://a.com/", 5), (0, "https://a.com/", 5)]
    entries = [(rng.choice(["l1", "l2", None]), rng.choice(["a.com", "b.a.com", "x.org", "COM", None]), a, rng.choice([None, a, a + rng.randrange(1, 200_000)])) for a in [rng.randrange(0, 400_000) for _ in range(40)]]
    frame = spark.createDataFrame(captures, "id long, url string, fetched_at long").withColumn("t", F.lit("extra")).withColumn("lists", F.lit(1)).withColumn("host", F.lit("x"))
    got = urlfilter.temporal_filter(frame, spark.createDataFrame(entries, "list_name string, pattern string, valid_from long, valid_to long"), bucket=50_000).collect()

    def brute(url, t):
        if url is None or t is None:
            return ""
        host = re.search(r"//(?:[^@]*@)?([^/:]*)", url)[1].lower()
        return ",".join(sorted({n for n, p, a, b in entries if n and p and (host == p.lower() or host.endswith("." + p.lower())) and a <= t and (b is None or t < b)}))

    assert Counter((r["id"], r["url"], r["fetched_at"], r["lists"], r["blocked"]) for r in got) == Counter((i, u, t, brute(u, t), brute(u, t) != "") for i, u, t in captures)


def test_url_filter_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", 3)], "id long, url string, fetched_at long")
    entries = spark.createDataFrame([("l", "a.b", 0, None)], "list_name string, pattern string, valid_from long, valid_to long")
    assert urlfilter.temporal_filter(captures, entries.limit(0)).first()["blocked"] is False
    assert urlfilter.temporal_filter(captures.limit(0), entries).count() == 0


def test_pipeline_by_stages(spark):
    """Each stage against the operator on its own input, rows against what must be left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL).cache()
        before, ids = docs.collect(), Counter(r["doc_id"] for r in after.collect()) if name != "packing" else None
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
            assert ids == Counter(r["doc_id"] for r in before if r["doc_id"] not in bad)
        elif name == "near_duplicates":
            groups = {r["component_id"] for r in neardup.near_duplicates(docs).collect()}
            assert set(ids) == groups and len(ids) < len(before)
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontam.contaminated(docs, bench).collect()}
            assert set(ids) == {r["doc_id"] for r in before} - bad
        elif name == "pii":
            model, texts = pii.train(), {r["doc_id"]: r["text"] for r in after.collect()}
            assert all(texts[r["doc_id"]] == pii.redact(r["text"], pii.find(r["text"], model)) for r in before)
            assert not any(pii.base_spans(t) for t in texts.values())
        else:
            t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            want = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
            got = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
            assert {r["doc_id"]: r["n"] for r in got} == want == {r["doc_id"]: r["m"] for r in got}
        if name != "packing":
            assert after.columns == columns
        docs = after
    # where documents are cut depends on how they lie in partitions; what is packed doesn't
    assert {r["doc_id"]: r["n"] for r in corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_pipeline_edges(spark, edges, nothing):
    for frame in (edges, nothing):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).cache()
            docs.count()
        assert (docs.count() > 0) == (frame is edges)
