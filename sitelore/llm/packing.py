"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every task packs the documents of its own partition as they stream by, so
nothing is shuffled and a block of some windows bounds the memory.  Within a
block, differencing merges partial partitions with opposing imbalances until
one partition into near-equal windows is left.  A window over its capacity
gives its surplus, cut off the last document in it, to windows with room; when
there is too little room, the number of windows rises.  The emptiest window is
carried into the next block; at the end of the partition what is left is cut
into power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_memory
from .tokens import encoder_for, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: partition items into ``windows`` groups with sums as equal as differencing gets them."""
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, np.array([size], np.int64), [[i]]))  # the empty windows are left out
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, loads, groups = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        both = len(loads) + len(other)
        if both <= windows:
            loads, groups = np.concatenate([loads, other]), groups + others
        else:  # the heaviest of one meets the lightest of the other
            shared = both - windows
            alone_a, alone_b = len(loads) - shared, len(other) - shared
            merged = loads[alone_a:] + other[alone_b:][::-1]
            groups = groups[:alone_a] + others[:alone_b] + [a + b for a, b in zip(groups[alone_a:], others[alone_b:][::-1], strict=True)]
            loads = np.concatenate([loads[:alone_a], other[:alone_b], merged])
        order = np.argsort(-loads, kind="stable")
        loads, groups = loads[order], [groups[j] for j in order]
        spread = int(loads[0]) - (int(loads[-1]) if len(loads) == windows else 0)
        heapq.heappush(heap, (-spread, serial, loads, groups))
        serial += 1
    groups = heap[0][3] if heap else []
    return groups + [[] for _ in range(windows - len(groups))]


class Packer:
    """Packs (document, start, length) pieces into windows; ``emit`` gets each finished window's pieces."""

    def __init__(self, capacity: int, windows: int) -> None:
        self.capacity, self.block = capacity, capacity * windows
        self.pieces: list[tuple[int, int, int]] = []
        self.total = 0

    def add(self, doc: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        start = 0
        while length - start >= self.capacity:  # a full window of its own
            yield [(doc, start, self.capacity)]
            start += self.capacity
        if length > start:
            self.pieces.append((doc, start, length - start))
            self.total += length - start
        if self.total >= self.block:
            yield from self.flush(last=False)

    def _items(self) -> list[list[tuple[int, int, int]]]:
        """Small neighbours go together, so that differencing gets few items however short documents are."""
        items: list[list[tuple[int, int, int]]] = []
        room = 0
        for piece in self.pieces:
            if piece[2] <= room:
                items[-1].append(piece)
                room -= piece[2]
            else:
                items.append([piece])
                room = self.capacity // 16 - piece[2]
        return items

    def flush(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        if not self.total:
            return
        items = self._items()
        sizes = [sum(p[2] for p in item) for item in items]
        count = max(1, self.total // self.capacity)
        while True:
            groups = difference(sizes, count)
            loads = [sum(sizes[i] for i in g) for g in groups]
            if sum(max(0, x - self.capacity) for x in loads) <= sum(max(0, self.capacity - x) for x in loads):
                break
            count += 1
        filled = [[p for i in g for p in items[i]] for g in groups]
        tail = min(range(count), key=lambda i: loads[i])
        spare: list[tuple[int, int, int]] = []
        for window, load in zip(filled, loads, strict=True):
            over = load - self.capacity
            while over > 0:
                over -= _move(window, spare, over)
        spare = filled[tail] + spare  # taken from its end, surplus first
        for i, window in enumerate(filled):
            room = self.capacity - min(loads[i], self.capacity)
            while i != tail and room > 0 and spare:
                room -= _move(spare, window, room)
            if i != tail:
                yield window
        self.pieces, self.total = spare, sum(p[2] for p in spare)
        while self.total >= self.capacity:
            yield self._take(self.capacity)
        while last and self.total:
            yield self._take(1 << (self.total.bit_length() - 1))

    def _take(self, length: int) -> list[tuple[int, int, int]]:
        window: list[tuple[int, int, int]] = []
        self.total -= length
        while length:
            length -= _move(self.pieces, window, length)
        return window


def _move(source: list, target: list, most: int) -> int:
    """Move the last piece, or the ``most`` last ids of it."""
    doc, start, length = source.pop()
    if length > most:
        source.append((doc, start, length - most))
        start, length = start + length - most, most
    target.append((doc, start, length))
    return length


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 4096, windows: int = 96) -> DataFrame:
    """One row per piece of every document.

    A null text is an empty one: its document holds the end id alone.  Ties and
    repeated rows are packed as separate documents; a null id stays null; other
    columns are ignored; an empty table gives no rows.  ``sequence_id`` holds the
    partition in its upper 31 bits, so ids are unique without a shuffle and a
    recomputed task gives the same ids again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        free_memory()
        encoder, packer = encoder_for(tokenizer, max_pieces=400_000), Packer(capacity, windows)
        base, serial, sequences = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, 0, 0
        held: dict[int, tuple[int | None, np.ndarray]] = {}

        def rows(window) -> dict[str, list]:
            nonlocal sequences
            out, offset = [], 0
            for doc, start, length in window:
                doc_id, ids = held[doc]
                out.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), base + sequences, offset))
                offset += length
            sequences += 1
            return out

        def table(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(texts):
                out: list[tuple] = []
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(sizes)
                for k in range(b - a):
                    own = np.empty(int(sizes[k]) + 1, "<u4")
                    own[:-1], own[-1] = ids[ends[k] - sizes[k] : ends[k]], end_id
                    held[serial] = (doc_ids[a + k], own)
                    for window in packer.add(serial, len(own)):
                        out += rows(window)
                    serial += 1
                alive = {p[0] for p in packer.pieces}
                held = {k: v for k, v in held.items() if k in alive}
                yield from table(out)
        out = []
        for window in packer.flush(last=True):
            out += rows(window)
        yield from table(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
