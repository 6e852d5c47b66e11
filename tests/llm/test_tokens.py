"""Packing and token tables: the ids of whole texts, exact round trips."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitelore.llm import huffman, packing, queries
from sitelore.llm.tokens import PieceEncoder, slices

from ..conftest import SMALL
from .conftest import EDGES

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ENCODERS = {n: PieceEncoder(P.path(n), max_pieces=500) for n in FILES}
PLAIN = {n: plain(n) for n in FILES}
pieces = st.sampled_from(["a", "The", " ", "  ", "\n", "\n\n", "\t", ".", ",", "..", "7", "77", "'s", "don't", "é", "́", "日", "🤦🏼", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "\x00", "\x1c", " ", "​", "İ", "ΣΑΣ", "_", "-", "word."])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=14).map("".join), min_size=1, max_size=5))
def test_pieces_are_the_whole_text(name, texts):
    ids, sizes = ENCODERS[name].encode(pa.array(texts))
    want = [PLAIN[name](t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize(("name", "ids"), [("word_bpe_49k.json", [320, 49407, 321]), ("byte_bpe_50k.json", [64, 220, 50256, 275])])
def test_added_tokens_have_their_own_ids(name, ids):
    got, sizes = ENCODERS[name].encode(pa.array(["a <|endoftext|> b", "plain"]))
    assert got[: sizes[0]].tolist() == ids == PLAIN[name]("a <|endoftext|> b")


def test_slices_cover_all():
    texts = pa.array(["a" * n for n in (0, 10, 500, 3, 900, 1)] + [None])
    got = list(slices(texts, 400))
    assert got[0][0] == 0 and got[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=60), st.integers(1, 9))
def test_difference_partitions(sizes, windows):
    groups = packing.difference(sizes, windows)
    assert len(groups) == windows and sorted(i for g in groups for i in g) == list(range(len(sizes)))


def test_difference_beats_or_meets_greedy_on_the_whole():
    rng, ours, greedy = np.random.default_rng(1), 0, 0
    for _ in range(50):
        sizes = rng.integers(1, 2000, 60).tolist()
        loads = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 6)]
        heap = [0] * 6
        for s in sorted(sizes, reverse=True):
            heapq.heapreplace(heap, heap[0] + s)
        ours, greedy = ours + max(loads) - min(loads), greedy + max(heap) - min(heap)
    assert ours < greedy


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=80), st.integers(1, 6))
def test_packer_is_gapless_and_unpadded(lengths, windows):
    packer, out = packing.Packer(64, windows), []
    for i, n in enumerate(lengths):
        out += packer.add(i, n)
    out += packer.flush(last=True)
    sizes = [sum(p[2] for p in w) for w in out]
    assert all(s == 64 or s < 64 and s & (s - 1) == 0 for s in sizes)
    assert sum(s != 64 for s in sizes) <= 6
    cover = defaultdict(list)
    for w in out:
        for doc, start, n in w:
            cover[doc].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(cover[i]):
            assert start == at
            at += k
        assert at == n


def check_packed(rows, want):
    """``want``: (doc id, ids) of each document, in any order."""
    left = defaultdict(int)
    for doc, ids in want:
        left[doc, len(ids)] += len(ids)
    sequences = defaultdict(list)
    known = defaultdict(list)
    for doc, ids in want:
        known[doc].append(ids)
    for r in rows:
        assert any(len(i) == r["doc_tokens"] and zlib.crc32(np.array(i[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for i in known[r["doc_id"]])
        left[r["doc_id"], r["doc_tokens"]] -= r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(left.values())
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_packing_edges(edges, nothing):
    path = P.path("word_bpe_49k.json")
    check_packed(packing.pack(edges, path).collect(), [(i, [*PLAIN["word_bpe_49k.json"](t), 2]) for i, t in EDGES])
    assert packing.pack(nothing, path).count() == 0


def test_packing_pads_little(spark):
    rows = queries.op9_packing(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    check_packed(rows, [(r["doc_id"], [*PLAIN["word_bpe_49k.json"](r["text"]), 2]) for r in docs])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=2, max_size=200).filter(any), st.integers(8, 18))
def test_code_lengths_are_a_full_limited_code(counts, most):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, most)
    used = counts > 0
    assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= most
    kraft = sum(2.0 ** -int(x) for x in lengths[used])
    assert kraft <= 1 and (used.sum() < 2 or kraft == 1)


def test_code_lengths_are_optimal_when_the_limit_is_loose():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = rng.integers(1, 1000, 40)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((huffman.code_lengths(counts).astype(int) * counts).sum()) == cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), min_size=1, max_size=700), min_size=1, max_size=4))
def test_blocks_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    data = huffman.encode_block(ids, [None, *range(1, len(docs))], np.array([len(d) for d in docs]), huffman.canonical(lengths), lengths)
    got, doc_ids, null, sizes = huffman.decode_block(data, huffman.decode_table(lengths))
    assert got.tolist() == ids.tolist() and sizes.tolist() == [len(d) for d in docs] and null[0] and doc_ids[1:].tolist() == list(range(1, len(docs)))
    with pytest.raises(ValueError, match="damaged"):
        huffman.decode_block(data[:-1] + bytes([data[-1] ^ 1]), huffman.decode_table(lengths))


def check_tokens(rows, docs):
    """In order of id, null first, then of the text's hash, that of a null text being the seed."""
    signed = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    want = [(i, [*PLAIN["byte_bpe_50k.json"](t), 0]) for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1]), d[1] is not None, d[1] or ""))]
    start, expected = 0, []
    for i, ids in want:
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows, key=lambda r: r[1]) == expected


def test_token_ids_edges(spark, edges, nothing, tmp_path):
    for name, docs, want in (("edges", edges, EDGES), ("nothing", nothing, [])):
        huffman.write_tokens(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/{name}")
        check_tokens([tuple(r) for r in huffman.read_tokens(spark, f"file://{tmp_path}/{name}").collect()], want)


def test_token_ids_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_tokens([tuple(r) for r in queries.op10_token_ids(spark, SMALL).collect()], docs)
