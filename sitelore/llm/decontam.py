"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Distances are edits of words (insert, delete, replace) after lower-casing and
dropping signs; an item of L words is found where a passage lies within
``(1 - similarity) * L`` edits of it.  One pass over the documents, no shuffle:

1. Windows of item size are laid at every word.  With at most k edits a passage
   keeps all but k of an item's different words, within L + k words; windows
   for which the occurrences of the item's rarer words rule that out are left
   out (an exact condition, so it costs no recall).
2. The CGK walk embeds each window: it repeats or advances by a random bit of
   (step, word), so that strings at small edit distance come to small Hamming
   distance.  A sample of the embedding's coordinates makes a key; equal keys of
   window and item make a candidate.  The walk and the sample are repeated until
   simulated edits of the items at the largest distance are found with the
   target recall.  Lengths that ``MOST_REPEATS`` walks don't bring there (texts of
   hundreds of words) need no luck: all windows left by step 1 are candidates of
   the very items that they were left for.
3. A candidate's passage is searched for the item by exact edit distance
   (bit-parallel dynamic programming).

The items' index is the only thing sent to tasks.  A benchmark over
``BLOCK_WORDS`` words is cut into blocks of items, each scanned against all
documents: one block's index is built, sent, used and freed before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, release, written
from .tokens import slices

SIMILARITY, RECALL, SAMPLED, MOST_REPEATS, BLOCK_WORDS = 0.8, 0.995, 2, 96, 400_000
#: An item's words count as rare up to this many items; commoner ones are added while fewer than LEAST would have to be left.
RARE, LEAST = 8, 5
SCHEMA = "doc_id long, item_id long, item_words int, distance int, similarity double, end_word int"
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def normal_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters, digits and underscores; an empty string stands where a text begins or ends with signs."""
    return pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^\\pL\\pN_]+", " "), " ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M3
    return x ^ (x >> np.uint64(29))


def cgk_keys(read, size: np.ndarray, seed: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Keys of strings, each under its own walk: ``read(rows, i)`` gives symbol ``i`` of the strings ``rows``, ``size`` their lengths.

    The walk: step j puts out the symbol under the cursor (0 past the end), which
    moves on by a random bit of (seed, j, symbol).  ``sampled`` (a row for each
    string, ascending) are the steps whose symbols make the key, with the seed.
    """
    order = np.argsort(-sampled[:, -1], kind="stable")  # walks that end early fall off the end
    size, seed, sampled = size[order], seed[order], sampled[order]
    cursor, key, walk = np.zeros(len(size), np.int64), _mix(seed * _M1), seed * _M3
    for j in range(int(sampled[0, -1]) + 1 if len(size) else 0):
        n = int(np.searchsorted(-sampled[:, -1], -j, "right"))
        at = cursor[:n]
        symbol = np.where(at < size[:n], read(order[:n], np.minimum(at, size[:n] - 1)), 0).astype(np.uint64)
        for c in range(sampled.shape[1]):
            hit = np.flatnonzero(sampled[:n, c] == j)
            key[hit] = _mix(key[hit] * _M2 + symbol[hit] + np.uint64(1))
        cursor[:n] = at + (_mix((symbol * _M1 + walk[:n]) ^ np.uint64(j * 0x5851F42D4C957F2D & 2**64 - 1)) >> np.uint64(63)).astype(np.int64)
    out = np.empty_like(key)
    out[order] = key
    return out


def _cuts(rows: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Ranges of windows with about ``most`` rows, by the running count of rows."""
    if not len(rows):
        return [], []
    at = np.unique(np.concatenate([[0], np.searchsorted(rows, np.arange(most, int(rows[-1]), most), "right"), [len(rows)]])).tolist()
    return at[:-1], at[1:]


def search(pattern: list[int], text: list[int], most: int) -> list[tuple[int, int]]:
    """(distance, end) of the best match of the pattern ending at a place of the text, for each run of places within ``most`` edits (Myers)."""
    m, masks = len(pattern), {}
    for i, s in enumerate(pattern):
        masks[s] = masks.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, found, best = full, 0, m, [], None
    for j, s in enumerate(text):
        eq = masks.get(s, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv & full
        if score <= most:
            best = min(best, (score, j + 1)) if best else (score, j + 1)
        elif best:
            found.append(best)
            best = None
    return [*found, best] if best else found


class Index:
    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 1) -> None:
        words = normal_words(pa.array([t for _, t in items], pa.string())).to_pylist()
        words = [[w for w in own if w] for own in words]
        # equal items share an entry; items without a word can't be found
        entries: dict[tuple[str, ...], list[int | None]] = {}
        for (item, _), own in zip(items, words, strict=True):
            if own:
                entries.setdefault(tuple(own), []).append(item)
        self.item_ids = list(entries.values())
        vocabulary = sorted({w for own in entries for w in own})
        self.vocabulary = pa.array(vocabulary, pa.string())
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.items = [np.array([number[w] for w in own], np.int64) for own in entries]
        self.edits = [math.floor((1 - similarity) * len(x) + 1e-9) for x in self.items]
        self.by_length: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            self.by_length.setdefault(len(x), []).append(i)
        self.recall, self.seed = recall, seed
        self.pairs = np.unique(np.concatenate([i * np.int64(len(vocabulary) + 1) + np.unique(x) for i, x in enumerate(self.items)])) if self.items else np.zeros(0, np.int64)
        self._postings(len(vocabulary))
        self.plans = {n: self._plan(n, own) for n, own in self.by_length.items()}
        self.exact = np.array([len(self.plans[len(x)][0]) == 0 for x in self.items], bool)  # found without walks
        self._tables()

    def _edited(self, x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
        out = x.tolist()
        for _ in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(out))) if out else 0
            if kind == 0 or not out:
                out.insert(at, 0)
            elif kind == 1:
                out[at] = 0
            else:
                out.pop(at)
        return np.array(out[: len(x)] + [0] * max(0, len(x) - len(out)), np.int64)

    def _plan(self, size: int, own: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Seeds and sampled steps of as many walks as find simulated edits with the target recall; none where ``MOST_REPEATS`` don't."""
        rng = np.random.default_rng([self.seed, size])
        some = [own[i] for i in rng.permutation(len(own))[:16]]
        edits = self.edits[own[0]]
        trial = np.repeat(np.stack([self.items[i] for i in some]), 24, 0)
        changed = np.stack([self._edited(x, edits, rng) for x in trial])
        missed, seeds, steps = np.ones(len(trial), bool), [], []
        while not seeds or edits and missed.mean() > 1 - self.recall:
            if len(seeds) == MOST_REPEATS:
                return np.zeros(0, np.uint64), np.zeros((0, SAMPLED), np.int64)
            seeds.append(int(rng.integers(1 << 62)))
            steps.append(np.sort(rng.permutation(max(SAMPLED, int(1.2 * size)))[:SAMPLED]))
            seed, sampled = np.full(len(trial), seeds[-1], np.uint64), np.repeat(steps[-1][None], len(trial), 0)
            keys = [cgk_keys(lambda r, i, rows=rows: rows[r, i], np.full(len(rows), size), seed, sampled) for rows in (trial, changed)]
            missed &= keys[0] != keys[1]
        return np.array(seeds, np.uint64), np.stack(steps)

    def _tables(self) -> None:
        """The keys of all items under all walks of their length, in one sorted table."""
        keys, entries = [], []
        for n, own in self.by_length.items():
            seeds, steps = self.plans[n]
            rows = np.repeat(np.stack([self.items[i] for i in own]), len(seeds), 0)
            keys.append(cgk_keys(lambda r, i, rows=rows: rows[r, i], np.full(len(rows), n), np.tile(seeds, len(own)), np.tile(steps, (len(own), 1))))
            entries.append(np.repeat(own, len(seeds)))
        if keys:
            keys, entries = np.concatenate(keys), np.concatenate(entries)
            order = np.argsort(keys, kind="stable")
            self.keys, self.entries = keys[order], entries[order]

    def _postings(self, words: int) -> None:
        """By word, the items for which it is a rarer word; by item, how many of these a passage must keep."""
        spread = np.zeros(words + 1, np.int64)
        for x in self.items:
            spread[np.unique(x)] += 1
        pairs, self.fewest = [], np.zeros(len(self.items), np.int64)
        for i, x in enumerate(self.items):
            own = np.unique(x)
            own = own[np.argsort(spread[own], kind="stable")]
            own = own[: max(int((spread[own] <= RARE).sum()), self.edits[i] + LEAST)]
            self.fewest[i] = max(1, len(own) - self.edits[i])
            pairs += [(int(w), i) for w in own]
        pairs.sort()
        self.post_items = np.array([i for _, i in pairs], np.int64)
        self.post_starts = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(words + 2))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.slack = np.array(self.edits, np.int64)

    def windows(self, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(length, start) of all item-sized windows that the words' occurrences leave possible, to be embedded; (start, entry) of those of exact items."""
        counts = (self.post_starts[1:] - self.post_starts[:-1])[ids]
        at = np.flatnonzero(counts)
        counts = counts[at]
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        ends = np.cumsum(counts)
        place = np.repeat(at, counts)
        item = self.post_items[np.repeat(self.post_starts[ids[at]] - (ends - counts), counts) + np.arange(int(ends[-1]))]
        order = np.sort(item << 40 | place)
        item, place = order >> 40, order & ((1 << 40) - 1)
        last = np.arange(len(item)) + self.fewest[item] - 1
        inside = last < len(item)
        last = np.minimum(last, len(item) - 1)
        width = self.sizes[item] + self.slack[item]
        good = np.flatnonzero(inside & (item[last] == item) & (place[last] - place < width))
        item, low, high = item[good], place[last[good]] - width[good] + 1, place[good]
        text = np.searchsorted(edge, high, "right") - 1
        same = edge[text + 1] > place[last[good]]
        low, high, item = np.maximum(low, edge[text])[same], high[same], item[same]

        def spread(own: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            times = high[own] - low[own] + 1
            ends = np.cumsum(times)
            starts = np.repeat(low[own] - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
            every = np.unique(np.repeat(what[own], times) << 40 | starts)
            return every >> 40, every & ((1 << 40) - 1)

        exact = self.exact[item]
        entries, places = spread(exact, item) if exact.any() else (np.zeros(0, np.int64),) * 2
        return *spread(~exact, self.sizes[item]), places, entries

    def scan(self, ids: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, entry, distance, end word) of all passages; ``ids`` the texts' words one after another, 0 for others, ``edge`` where texts begin."""
        hits: dict[tuple[int, int], list[int]] = {}
        lengths, starts, exact_starts, exact_entries = self.windows(ids, edge)

        def keep(first: np.ndarray, entry: np.ndarray) -> None:
            """Remember the windows that hold enough words of their candidates."""
            text = np.searchsorted(edge, first, "right") - 1
            good = self._enough(ids, first, np.minimum(self.sizes[entry] + self.slack[entry], edge[text + 1] - first), entry, self.sizes[entry] - self.slack[entry])
            for t, e, place in zip(text[good].tolist(), entry[good].tolist(), first[good].tolist(), strict=True):
                hits.setdefault((t, e), []).append(place)

        for a in range(0, len(exact_starts), 400_000):
            keep(exact_starts[a : a + 400_000], exact_entries[a : a + 400_000])
        walks = np.array([len(self.plans[n][0]) if n in self.plans else 0 for n in range(int(lengths.max(initial=0)) + 1)])
        rows = np.cumsum(walks[lengths]) if len(lengths) else np.zeros(0, np.int64)
        for a, b in zip(*_cuts(rows, 400_000), strict=True):
            n, first = lengths[a:b], starts[a:b]
            text = np.searchsorted(edge, first, "right") - 1
            room = edge[text + 1] - first
            size = np.minimum(n, room)
            seeds = np.concatenate([self.plans[x][0] for x in n.tolist()])
            steps = np.concatenate([self.plans[x][1] for x in n.tolist()])
            window = np.repeat(np.arange(b - a), walks[n])
            got = cgk_keys(lambda r, i, first=first[window]: ids[first[r] + i], size[window], seeds, steps)
            low = np.searchsorted(self.keys, got, "left")
            found = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == got)
            low, window = low[found], window[found]
            times = np.searchsorted(self.keys, got[found], "right") - low
            pair = np.repeat(window, times) << 32 | self.entries[np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
            pair = np.unique(pair)
            keep(first[pair >> 32], pair & 0xFFFFFFFF)
        for (t, e), places in sorted(hits.items()):
            yield from self._verify(ids, int(edge[t]), int(edge[t + 1]), t, e, sorted(set(places)))

    def _enough(self, ids, first, room, entry, fewest) -> np.ndarray:
        """Whether at least ``fewest`` of a window's words are words of its candidate: what any match must have."""
        count = np.zeros(len(first), np.int32)
        span = len(self.vocabulary) + 1
        for i in range(int(room.max()) if len(room) else 0):
            inside = i < room
            word = np.where(inside, ids[np.where(inside, first + i, 0)], 0)
            pair = entry * np.int64(span) + word
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            count += (word > 0) & (self.pairs[at] == pair)
        return count >= fewest

    def _verify(self, ids, low, high, text, entry, places) -> Iterator[tuple[int, int, int, int]]:
        pattern, k = self.items[entry].tolist(), self.edits[entry]
        n, i = len(pattern), 0
        while i < len(places):
            a, b = max(low, places[i] - k), min(high, places[i] + n + k)
            while i < len(places) and places[i] - k <= b:
                b = min(high, places[i] + n + k)
                i += 1
            for distance, end in search(pattern, ids[a:b].tolist(), k):
                yield text, entry, distance, a + end - low


def contaminated(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and item found in it: the closest passage (least distance, then first end).

    Null texts hold nothing, null or wordless items are found nowhere; equal items
    are all reported; repeated rows each report; null ids stay null; other columns
    are ignored; empty tables give no rows.
    """
    out = None
    for last, index in _indexes(benchmark, similarity, recall, block_words):
        found, shared = _scan(docs, index)
        del index  # freed before the next is built
        if out is None and last:  # a single block
            return found
        found = written(found, "found")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...], similarity: float = SIMILARITY, recall: float = RECALL, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, the text among them) that hold no passage of any item.

    No join: a single block drops them in the pass that scans, each of several
    writes what it leaves for the next.  Null texts and null ids stay; rows that
    share an id, and repeated rows, are judged one by one; other columns than
    ``keep`` are ignored; an empty benchmark drops nothing, an empty table gives no
    rows.
    """
    left = docs.select(*keep)
    before = None
    for last, index in _indexes(benchmark, similarity, recall, block_words):
        kept, shared = _drop(left, index)
        del index
        if before is None and last:
            return kept
        left = written(kept, "uncontaminated")
        shared.destroy()
        release(before)
        before = left
    return left


def _indexes(benchmark: DataFrame, similarity: float, recall: float, block_words: int) -> Iterator[tuple[bool, Index]]:
    """Indexes of about ``block_words`` words each, over all items together, and whether each is the last; one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_words))
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield block == blocks - 1, Index(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=str), similarity, recall)


def _hits(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, entry, distance, end word) of all passages in a batch's texts."""
    for a, b in slices(texts) if index.items else ():
        cut = normal_words(texts.slice(a, b - a))
        ids = pc.fill_null(pc.add(pc.index_in(cut.flatten(), index.vocabulary), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edge = (cut.offsets.to_numpy() - cut.offsets[0].as_py()).astype(np.int64)
        for text, entry, distance, end in index.scan(ids, edge):
            yield a + text, entry, distance, end


def _drop(docs: DataFrame, index: Index) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in _hits(shared.value, batch.column("text"))]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema), shared


def _scan(docs: DataFrame, index: Index) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        index: Index = shared.value
        for batch in batches:
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for row, entry, distance, end in _hits(index, batch.column("text")):
                best[row, entry] = min(best.get((row, entry), (1 << 30, 0)), (distance, end))
            for (row, entry), (distance, end) in best.items():
                n = len(index.items[entry])
                rows += [(doc_ids[row], item, n, distance, 1 - distance / n, end) for item in index.item_ids[entry]]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA), shared
