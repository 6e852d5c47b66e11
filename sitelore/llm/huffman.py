"""Token ids as a binary table: canonical length-limited Huffman codes in independent blocks.

``write_tokens`` tokenizes documents in ascending ``doc_id`` order, counts ids
over the whole corpus, fits one code to the counts and writes two tables:
``codebook`` (one row: the code length of every id) and ``blocks`` (one row per
block: some documents, their sizes, the bit stream, and a bit offset every
``CHECKPOINT`` ids).  Spark's own writer commits the files, so a lost executor
leaves no half-written block.  A block is decoded alone, all its checkpoints in
lockstep, each step one look-up in a table of ``2 ** MAX_BITS`` prefixes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_memory, scratch_path
from .tokens import encoder_for, slices

MAGIC, CHECKPOINT, MAX_BITS, BLOCK_IDS = b"SLH1", 256, 18, 1 << 18
_HEAD = struct.Struct("<4sIQII")  # magic, documents, ids, checkpoints, crc32 of what follows

IDS = "shard int, pos long, doc_id long, n_tokens long, ids binary"
BLOCKS = "shard int, pos long, n_tokens long, first_doc long, last_doc long, data binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits for all ids with a count (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit in {max_bits} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, marks = leaves, [np.ones(n, bool)]  # True: a leaf
    for _ in range(max_bits - 1):
        m = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:m:2] + level[1:m:2]])
        at = np.argsort(both, kind="stable")
        level = both[at]
        marks.append(at < n)
    take = 2 * n - 2
    for mark in reversed(marks):
        got = int(mark[:take].sum())
        lengths[order[:got]] += 1
        take = 2 * (take - got)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        size = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        codes[order] = (np.cumsum(size) - size) >> (top - lengths[order]).astype(np.uint64)
    return codes


def encode_block(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Head; then by document its id, whether that is null, and its size; bit offsets of the checkpoints; the bits."""
    n = lengths[ids].astype(np.uint64)
    ends = np.cumsum(n)
    at = ends - n
    bits = int(ends[-1]) if len(ends) else 0
    word, inside = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
    lane = codes[ids] << (np.uint64(64) - inside - n)
    words = (bits + 31) // 32 + 1
    stream = np.bincount(word, (lane >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (lane & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:words]
    marks = at[::CHECKPOINT].astype("<u4")
    own = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    body = own + sizes.astype("<u4").tobytes() + marks.tobytes() + stream.astype(">u4").tobytes()
    return _HEAD.pack(MAGIC, len(sizes), len(ids), len(marks), zlib.crc32(body)) + body


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the next ``MAX_BITS`` bits: the id and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    filled = np.repeat(order, span)
    ids[: len(filled)], bits[: len(filled)] = filled, lengths[filled]
    return ids, bits


def decode_block(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block; its documents' ids, whether those are null, and sizes."""
    magic, docs, count, lanes, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
        raise ValueError("a damaged block")
    doc_ids = np.frombuffer(data, "<i8", docs, _HEAD.size)
    null = np.frombuffer(data, np.uint8, docs, _HEAD.size + 8 * docs).astype(bool)
    sizes = np.frombuffer(data, "<u4", docs, _HEAD.size + 9 * docs)
    pos = np.frombuffer(data, "<u4", lanes, _HEAD.size + 13 * docs).astype(np.int64)
    words = np.frombuffer(data, ">u4", -1, _HEAD.size + 13 * docs + 4 * lanes).astype(np.uint64)
    wide = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    ids, bits = table
    out = np.empty((CHECKPOINT, lanes), np.uint32)
    shift, mask, last = 64 - MAX_BITS, (1 << MAX_BITS) - 1, len(wide) - 1
    for step in range(min(CHECKPOINT, count)):
        peek = (wide[np.minimum(pos >> 5, last)] >> (shift - (pos & 31)).astype(np.uint64)).astype(np.int64) & mask
        out[step] = ids[peek]
        pos += bits[peek]
    return out.T.reshape(-1)[:count], doc_ids, null, sizes


def width_for(tokenizer: str) -> str:
    """How ids are held between passes: two bytes where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize_sorted(docs: DataFrame, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """``IDS`` rows in ascending ``doc_id`` order: range partitions, numbered in order, sorted within.

    Text is shuffled, not ids: the range sampling then reads only the scan.  Rows
    that share an id, nulls among them, are ordered by a hash of their text, so that
    a range of one id splits as well.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    width = width_for(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        free_memory()
        encoder, shard, pos = encoder_for(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in slices(texts):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                whole = np.insert(ids, np.cumsum(sizes), end_id).astype(width)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                at = pos + ends - sizes
                pos += int(ends[-1])
                offsets = np.concatenate([[0], ends * whole.itemsize]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard, np.int32)), pa.array(at), doc_ids.slice(a, b - a).cast(pa.int64()), pa.array(sizes), held], names=["shard", "pos", "doc_id", "n_tokens", "ids"])

    return ordered.mapInArrow(run, IDS)


def _all_ids(column: pa.Array, width: str) -> np.ndarray:
    """The ids of a batch's rows one after another, without a copy."""
    _, offsets, data = column.buffers()
    if data is None:
        return np.zeros(0, width)
    edge = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, width, (int(edge[-1]) - int(edge[0])) // np.dtype(width).itemsize, int(edge[0]))


def id_counts(ids: DataFrame, width: str) -> np.ndarray:
    """Counts of all ids of the corpus: summed in each task, then by id; the vocabulary bounds what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(_all_ids(batch.column("ids"), width), minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 0) -> None:
    """Write ``path/codebook`` and ``path/blocks``.

    A null text is an empty one: its document holds the end id alone.  Rows with
    equal ids follow each other by a hash of their text, null ids come first; other columns are
    ignored; an empty table gives an empty codebook and no blocks.
    """
    spark = docs.sparkSession
    held = scratch_path(spark, "ids")
    tokenize_sorted(docs, tokenizer, end_id=end_id).write.option("compression", "zstd").parquet(held)
    ids = spark.read.schema(IDS).parquet(held)
    width = width_for(tokenizer)
    lengths = code_lengths(id_counts(ids, width))
    spark.createDataFrame([(lengths.tobytes(), MAX_BITS, CHECKPOINT)], "lengths binary, max_bits int, checkpoint int").coalesce(1).write.parquet(f"{path}/codebook")
    shards = {r["shard"]: r["n"] for r in ids.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each range partition
    starts, at = {}, 0
    for shard in sorted(shards):
        starts[shard] = at
        at += shards[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("pos", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("data", pa.binary())])
        codes = canonical(lengths)
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            parts = [np.frombuffer(row[4], width) for row in held]
            data = encode_block(np.concatenate(parts), [r[2] for r in held], np.fromiter(map(len, parts), np.int64, len(parts)), codes, lengths)
            row = {"shard": held[0][0], "pos": starts[held[0][0]] + held[0][1], "n_tokens": sum(r[3] for r in held), "first_doc": held[0][2], "last_doc": held[-1][2], "data": data}
            return pa.RecordBatch.from_pylist([row], schema)

        total = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + held[-1][3] or total >= BLOCK_IDS):
                    yield block()
                    held, total = [], 0
                held.append(row)
                total += row[3]
        if held:
            yield block()

    ids.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.  Blocks are read independently."""
    book = spark.read.parquet(f"{path}/codebook").collect()[0]
    lengths = np.frombuffer(book["lengths"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for pos, data in zip(batch.column("pos").to_pylist(), batch.column("data").to_pylist(), strict=True):
                ids, doc_ids, null, sizes = decode_block(data, table)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes, dtype=np.int64)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null), pa.array(pos + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("pos", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
