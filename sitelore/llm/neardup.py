"""Near duplicates by SimHash with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit in one of their two 32-bit halves.  So each distinct fingerprint is indexed
by its halves, and by its halves with each single bit made a wildcard; an
equality of keys finds every pair, which is then verified.  Copies collapse to
one fingerprint before that.  Pairs are never written out: each bucket of equal
keys yields the stars of its verified links, which keep all reachability.  A
bucket over ``cap`` fingerprints, known from counts beforehand, is never formed:
its rows are indexed again by the same rule on the rest of the bits (16, then 8
bits a segment), after which at most 2,048 different fingerprints can share a
key: the split is exact, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, hub_join, release, written
from .components import components

BITS, CAP = 3, 2048


def fingerprint(text: str, words: int = 3) -> int:
    """Bitwise majority of the XXH64 hashes (seed 42) of all word shingles; 0 for a text without a word."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 60_000):  # four 16-bit counters to a word don't overflow
        part = hashes[at : at + 60_000]
        for bit in range(16):
            lanes = int(((part >> np.uint64(bit)) & np.uint64(0x0001000100010001)).sum(dtype=np.uint64))
            for lane in range(4):
                counts[bit + 16 * lane] += lanes >> (16 * lane) & 0xFFFF
    value = 0
    for bit in np.flatnonzero(2 * counts > n).tolist():
        value |= 1 << bit
    return value


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            fps = np.fromiter((fingerprint(t or "", words) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp): 33 keys a half.  A key holds the half, the wildcard's place (32: none) and the half's other bits."""
    half = "(case when s = 0 then fp & 4294967295L else shiftrightunsigned(fp, 32) end)"
    place = "explode(transform(sequence(0, 65), i -> struct(cast(i / 33 as int) as s, i % 33 as p))) as k"
    return (
        fps.select("fp", F.expr(place)).select("fp", "k.s", "k.p")
        .select(F.expr(f"shiftleft(cast(s * 33 + p as long), 32) | ({half} & (case when p = 32 then -1L else ~shiftleft(1L, p) end))").alias("key"), "fp")
    )


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links among different fingerprints (in ascending order): member, root."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= BITS
            found = left[near]
            left = left[~near]
            queue += found.tolist()
            a.append(found)
            b.append(np.full(len(found), root))
    member, root = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return fps[member], fps[root]


def _again(fps: np.ndarray, key: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the next level for a large bucket: its own key with each segment, one bit a wildcard, of the bits still free.

    Level 1 left the other half free, level 2 the other 16 bits of that half."""
    if level == 1:
        free, segments, width = (32 if (key >> 32) < 33 else 0), 2, 16
    else:
        free, segments, width = key & 0x3F, 2, 8
    keys, values = [], []
    for s in range(segments):
        low = free + s * width
        other = free + (1 - s) * width  # what stays free below this key
        own = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for p in range(width):
            # a mixed 58-bit digest: equal parts give equal keys, and a chance equality only adds pairs that verification drops
            mixed = (own & np.uint64(~(1 << p) & 0xFFFF)) + np.uint64((s * width + p) << 20)
            mixed = (mixed ^ np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(((mixed >> np.uint64(7)) & np.uint64(0x01FFFFFFFFFFFFC0)) | np.uint64(other))
            values.append(fps)
    return np.concatenate(keys).view(np.int64), np.concatenate(values).view(np.int64)


def _deepened(hot: DataFrame, level: int) -> DataFrame:
    """(key, fp) of large buckets to (key, fp) of the next level, row by row wherever the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            order = np.argsort(keys, kind="stable")
            cut = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(order, cut):
                if len(part):
                    a, b = _again(fps[part], int(keys[part[0]]), level)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["key", "fp"])

    return hot.select("key", "fp").mapInArrow(run, "key long, fp long")


def _buckets(keyed: DataFrame, level: int) -> DataFrame:
    """Equal keys brought together: (a, b), the stars of the links in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(keys)) + 1
            edges = np.concatenate([[0], cut, [len(keys)]])
            a, b = [], []
            for i in np.flatnonzero(np.diff(edges) > 1):
                key, own = int(keys[edges[i]]), fps[edges[i] : edges[i + 1]].view(np.uint64)
                if level == 1 and (key >> 32) % 33 < 32:  # with a wildcard: only a pair that differs there is new
                    bit = np.uint64((key >> 32) % 33 + 32 * ((key >> 32) // 33))
                    side = (own >> bit) & np.uint64(1)
                    if side.all() or not side.any():
                        continue
                if len(own) == 2:
                    x, y = (own[1:], own[:1]) if int(own[0] ^ own[1]).bit_count() <= BITS else (own[:0], own[:0])
                else:
                    x, y = _stars(own)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest_k, batch.column("key").to_numpy()])
            fps = np.concatenate([rest_f, batch.column("fp").to_numpy()])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from done(keys[:last], fps[:last])
            rest_k, rest_f = keys[last:], fps[last:]
        if len(rest_k):
            yield from done(rest_k, rest_f)

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def _halves(fps: DataFrame) -> DataFrame:
    """(fp, s, half): each fingerprint with either half."""
    return fps.select("fp", F.explode(F.array(F.expr("struct(0 as s, fp & 4294967295L as half)"), F.expr("struct(1 as s, shiftrightunsigned(fp, 32) as half)"))).alias("h")).select("fp", "h.*")


def _keyed_around(fps: DataFrame, counts: DataFrame, large: DataFrame, size: int) -> DataFrame:
    """(key, fp, deep) where halves are ``large``: ``deep`` keys go on to the next level, the others make buckets.

    A wildcard key of a large half serves only if the half that differs there
    exists; all its other wildcard keys, which would hold nothing but the half
    itself, are left out: equal halves meet under the key without a wildcard.
    """
    place = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p")
    near = large.select("s", F.col("half").alias("own"), place).select("s", "own", F.expr("own ^ shiftleft(1L, p)").alias("half"), F.expr("shiftleft(1L, p)").alias("bit"))
    near = near.join(counts.select("s", "half"), ["s", "half"], "left_semi")
    bits = (
        large.select("s", "half", F.lit(1 << 32).alias("bit"), F.lit(True).alias("is_large")).unionByName(near.select("s", "half", "bit", F.lit(False).alias("is_large")))
        .unionByName(near.select("s", F.col("own").alias("half"), "bit", F.lit(True).alias("is_large")))
    )
    marks = bits.groupBy("s", "half").agg(F.bit_or("bit").alias("bits"), F.max("is_large").alias("is_large")).join(counts, ["s", "half"])
    held = hub_join(_halves(fps), marks, ["s", "half"], 2 * size, "left")
    rows = held.select("fp", "s", "half", "bits", "is_large", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("p"))
    rows = rows.withColumn("deep", F.coalesce(F.expr("(shiftright(bits, p) & 1) = 1"), F.lit(False))).where("deep or is_large is null or not is_large")
    return rows.select(F.expr("shiftleft(cast(s * 33 + p as long), 32) | (half & (case when p = 32 then -1L else ~shiftleft(1L, p) end))").alias("key"), "fp", "deep")


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Edges (a, b) among the different fingerprints ``fp`` that connect all that differ in at most three bits.

    Keys of large buckets are known from counts before any bucket is formed:
    their rows go to the next level where they lie, so no task gathers them.  What
    is left of a bucket is at most twice ``cap``, or 2,048 at the last level.  The
    tables written for that are in the result's ``_held``.
    """
    size = fps.count()
    counts = _halves(fps).groupBy("s", "half").agg(F.count("*").alias("n"))
    large, held = written(counts.where(F.col("n") > cap), "large", rows=2 * size // cap + 1), []
    held.append(large)
    if large.isEmpty():
        edges = _buckets(_keyed(fps), 1)
        edges._held = held
        return edges
    marked = _keyed_around(fps, counts, large, size)
    edges = _buckets(marked.where("not deep").select("key", "fp"), 1)
    deeper = written(_deepened(marked.where("deep"), 1), "keys2")
    held.append(deeper)
    sizes = deeper.groupBy("key").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > cap).withColumn("large", F.lit(True)), "large", rows=size)
    held.append(large)
    if large.isEmpty():
        edges = edges.unionByName(_buckets(deeper, 2))
    else:
        marked = hub_join(deeper, large, ["key"], deeper.count(), "left")
        last = written(_deepened(marked.where("large"), 2), "keys3")
        held.append(last)
        edges = edges.unionByName(_buckets(marked.where("large is null").select("key", "fp"), 2)).unionByName(_buckets(last, 3))
    edges._held = held
    return edges


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    A null text is an empty one; texts without a word share fingerprint zero.
    Rows with equal ids each get a row; null ids count for no minimum, so a
    group of null ids alone has a null component.  Other columns are ignored; an
    empty table gives no rows.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    size = prints.count()
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes", rows=16 * size)  # smaller files: each row becomes 66 keys
    found = links(nodes.select("fp"))
    edges = found.persist(StorageLevel.DISK_ONLY)  # read twice; what a lost executor held is worked out again
    roots = components(edges)
    edges.unpersist()
    release(*found._held)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    groups = written(hub_join(named, least, ["root"], size).select("fp", "component_id", F.col("copies").alias("n")), "groups", rows=size)
    release(nodes, roots)
    out = hub_join(prints, groups, ["fp"], size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out._held = [prints, groups]  # what the rows are read from: a caller that has written them may release these
    return out
