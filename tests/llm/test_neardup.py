"""SimHash against a brute-force version."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from sitelore.llm import neardup, queries
from sitelore.llm.components import components

from ..conftest import SMALL
from .conftest import EDGES


def brute_print(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps: np.ndarray) -> list[int]:
    label = np.full(len(fps), -1)
    for i in range(len(fps)):
        if label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                near = np.flatnonzero((np.bitwise_count(fps ^ fps[stack.pop()]) <= 3) & (label < 0))
                label[near] = i
                stack += near.tolist()
    return label.tolist()


def test_fingerprints(spark):
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect():
        assert neardup.fingerprint(row["text"]) == brute_print(row["text"])
    for text in ("", "A", "a B", "a b\x0bc", "a\x1cb C d", "É É é é", "x " * 70_001):
        assert neardup.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("cap", [2048, 40, 6])
def test_links_keep_all_reachability(spark, cap):
    """Also where buckets are split: a small ``cap`` sends them to the next levels."""
    rng = np.random.default_rng(5)
    fps = set(map(int, rng.integers(0, 2**63, 200)))
    for base in list(fps)[:60]:
        for _ in range(8):
            value = base
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                value ^= 1 << int(bit)
            fps.add(value)
    hub = next(iter(fps))
    for _ in range(1_200):
        value = hub
        for bit in rng.integers(0, 64, rng.integers(1, 4)):
            value ^= 1 << int(bit)
        fps.add(value)
    keys = np.array(sorted(fps), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(neardup.links(frame, cap)).collect()}
    groups: dict[int, set[int]] = {}
    for fp, label in zip(keys.view(np.int64).tolist(), brute_groups(keys), strict=True):
        groups.setdefault(label, set()).add(roots.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def check(rows, docs):
    fps = np.array([brute_print(t) for _, t in docs], np.uint64)
    label, least = brute_groups(fps), {}
    for (i, _), g in zip(docs, label, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, f"{int(fp):016x}", least.get(g)) for (i, _), fp, g in zip(docs, fps, label, strict=True)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(queries.op4_near_duplicates(spark, SMALL).collect(), docs)


def test_edges(edges, nothing):
    check(neardup.near_duplicates(edges).collect(), EDGES)
    assert neardup.near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(900, 900), (1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == got[1001] == 1000 and 900 not in got
