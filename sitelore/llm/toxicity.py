"""Toxicity: a learned lexicon, misspellings by automata, and context windows.

1. A bounded sample of labelled documents gives term counts by label; terms far
   likelier in toxic documents make the lexicon, whole words and word stems.
2. Every word of every document runs through the product of Levenshtein
   automata and the lexicon trie.
3. Around each hit a window of words is scored: quotation marks and words of
   reporting speak for quotation, address in the second person for abuse.
4. Boosted trees turn a document's hits, densities and window scores into a
   calibrated score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import crc_fold, free_memory, hash_sample, written
from .levenshtein import LexiconAutomaton, Term

TRAIN_ROWS, MOST_TERMS, WINDOW = 16_000, 120, 6
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"
_QUOTES = "\"“”„«»"
_REPORTING = frozenset("said says quoted quote wrote called calls word term phrase means sagte schrieb wort dit écrit mot dijo escribió palabra".split())
_ADDRESS = frozenset("you your you're youre u ur du dich dir ihr tu te toi vous vos tú usted eres sois yourself".split())
FEATURES = ("words", "exact", "fuzzy", "stem", "exact_density", "stem_density", "hit_density", "worst_window", "quoted", "addressed", "weight", "distinct")

TextTerms = list[tuple[Term, float]]


class _Memo(dict):
    """What a raw word matches, as (term number + 1) * 4 + errors; 0 for nothing."""

    def __init__(self, terms: list[Term]) -> None:
        super().__init__()
        self.automaton = LexiconAutomaton(terms)

    def __missing__(self, raw: str) -> int:
        found = self.automaton.match(raw.strip(_STRIP).lower())
        self[raw] = code = 0 if found is None else (found[1] + 1) * 4 + found[0]
        return code


def _words(texts: pa.Array) -> pa.ListArray:
    texts = pc.fill_null(texts, "")
    for space in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, space, " ")
    return pc.split_pattern(texts, " ")


def document_features(texts: pa.Array, memo: _Memo, weights: np.ndarray) -> np.ndarray:
    """``FEATURES`` of each text."""
    if len(memo) > 300_000:
        memo.clear()
    cut = _words(texts)
    words = cut.flatten().dictionary_encode()
    raw = words.dictionary.to_pylist()
    at = words.indices.to_numpy()
    codes = np.fromiter(map(memo.__getitem__, raw), np.int32, len(raw))[at]
    empty = np.fromiter((w == "" for w in raw), bool, len(raw))[at]
    edge = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    total = np.concatenate([[0], np.cumsum(~empty)])
    n = np.diff(total[edge])
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = np.log1p(n)
    hits = np.flatnonzero(codes)
    owner = np.searchsorted(edge, hits, "right") - 1
    for doc in np.unique(owner).tolist():
        a, b = int(edge[doc]), int(edge[doc + 1])
        own = hits[owner == doc] if len(hits) < 64 else hits[np.searchsorted(owner, doc) : np.searchsorted(owner, doc, "right")]
        exact = fuzzy = stem = quoted = addressed = weight = 0.0
        places = []
        for h in own.tolist():
            code = int(codes[h])
            term, errors = code // 4 - 1, code % 4
            window = [raw[at[k]] for k in range(max(a, h - WINDOW), min(b, h + WINDOW + 1))]
            plain = [w.strip(_STRIP).lower() for w in window]
            middle = min(h - a, WINDOW)
            before = sum(w.count(q) for w in window[:middle] for q in _QUOTES)
            after = sum(w.count(q) for w in window[middle + 1 :] for q in _QUOTES)
            here = window[middle]
            is_quoted = here[:1] in _QUOTES and here[-1:] in _QUOTES or before > 0 and after > 0 or any(w in _REPORTING for w in plain)
            is_address = any(w in _ADDRESS for w in plain)
            factor = (0.25 if is_quoted else 1.0) * (1.5 if is_address else 1.0) * (1 - 0.3 * errors)
            if memo.automaton.terms[term].stem:
                stem += 1
            elif errors:
                fuzzy += 1
            else:
                exact += 1
            quoted += is_quoted
            addressed += is_address
            weight += factor * weights[term]
            places.append(h)
        p = np.array(places)
        worst = int((np.searchsorted(p, p + 50, "right") - np.arange(len(p))).max())
        size = max(1, int(n[doc]))
        out[doc, 1:] = (math.log1p(exact), math.log1p(fuzzy), math.log1p(stem), exact / size * 100, stem / size * 100, len(p) / size * 100, worst, quoted / len(p), addressed / len(p), math.log1p(weight), len(set((codes[own] // 4).tolist())))
    return out


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of about ``most`` labelled documents outside fold 0, chosen by id hash."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where(crc_fold(F.col("doc_id")) != 0)
    own = hash_sample(own, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", F.col("toxic") >= 0.5)  # broadcast: about ``most`` rows


def learn_lexicon(rows: DataFrame, *, most: int = MOST_TERMS) -> TextTerms:
    """Terms with their log-odds by the likelihood ratio of the label: whole words, and stems of three to eight letters, these also by the documents that hold them twice.  Copies of a text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        sizes = [0, 0]
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(w.strip(_STRIP).lower() for w in (text or "").split())
                stems: Counter = Counter()
                for w, n in words.items():
                    for k in range(3, min(8, len(w) - 1) + 1):
                        stems[w[:k]] += n
                terms = {w + "$" for w in words if 0 < len(w) <= 40} | stems.keys() | {t + "+" for t, n in stems.items() if n > 1}
                counts[bool(toxic)].update(terms)
                sizes[bool(toxic)] += 1
        terms = ["", *(counts[0].keys() | counts[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sizes[1], *(counts[1][t] for t in terms[1:])], pa.int64()), pa.array([sizes[0], *(counts[0][t] for t in terms[1:])], pa.int64())], names=["term", "p", "n"])

    counted = written(rows.dropDuplicates(["text"]).mapInArrow(run, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p >= 5 or term = ''"), "terms", rows=2_000_000)
    all_p, all_n = next(((r["p"], r["n"]) for r in counted.where("term = ''").collect()), (0, 0))
    if not all_p or not all_n:
        return []
    odds = F.log((F.col("p") + 0.5) / (all_p + 1.0)) - F.log((F.col("n") + 0.5) / (all_n + 1.0))
    seen, share = F.col("p") + F.col("n"), all_p / (all_p + all_n)
    ratio = 2 * (F.col("p") * F.log(F.col("p") / (seen * share)) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (seen * (1 - share)))).otherwise(0.0))
    top = counted.where("term <> ''").select("term", odds.alias("odds"), ratio.alias("ratio")).where("odds > 1.8 and ratio > 35").orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(20 * most).collect()
    best: dict[str, float] = {}
    for row in top:
        if not row["term"].endswith("$"):
            best[row["term"].rstrip("+")] = max(row["ratio"], best.get(row["term"].rstrip("+"), 0.0))
    taken: TextTerms = []
    for row in top:
        text = row["term"].rstrip("$+")
        whole = row["term"].endswith("$")
        if not whole:  # a shorter stem that says nearly as much covers more words
            text = next(text[:k] for k in range(3, len(text) + 1) if best.get(text[:k], 0.0) >= 0.8 * row["ratio"])
        if any(text.startswith(t.text) or t.text.startswith(text) for t, _ in taken) or len(text) < 3:
            continue
        errors = 0 if not whole or len(text) < 5 else 1 if len(text) < 10 else 2
        taken.append((Term(text, errors, stem=not whole), float(row["odds"])))
        if len(taken) == most:
            break
    return taken


class ToxicityModel:
    def __init__(self, terms: TextTerms, trees: Boosted | None, prior: float) -> None:
        self.terms, self.trees, self.prior = terms, trees, prior

    def scorer(self):
        memo, weights = _Memo([t for t, _ in self.terms]), np.array([w for _, w in self.terms] or [0.0])
        return lambda texts: self.trees.probability(document_features(texts, memo, weights)) if self.trees else np.full(len(texts), self.prior)


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from about ``train_rows`` labelled documents; without labels of both kinds every score is their share, at most 0.49."""
    rows = sample(docs, labels, train_rows).toDF("text", "toxic").persist(StorageLevel.DISK_ONLY)  # read twice; what a lost executor held is worked out again
    terms = learn_lexicon(rows)
    memo_terms, weights = [t for t, _ in terms], np.array([w for _, w in terms] or [0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(memo_terms)
        for batch in batches:
            x = document_features(batch.column("text"), memo, weights)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("toxic")], names=[*FEATURES, "toxic"])

    got = rows.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", toxic boolean").toPandas()
    rows.unpersist()
    got = got.sort_values(list(got.columns), kind="stable")  # the same order on every run
    x, y = got[list(FEATURES)].to_numpy(np.float64), got["toxic"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(terms, None, min(0.49, float(y.mean()) if len(y) else 0.0))
    part = np.random.default_rng(5).random(len(y)) < 0.75
    return ToxicityModel(terms, Boosted(rounds=40, depth=3, rate=0.25, least=2.0).fit(x[part], y[part]).calibrate(x[~part], y[~part]), 0.0)


def score(docs: DataFrame, model: ToxicityModel, *, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep`` (the text only ``with_text``) with ``score`` (0 to 1) and ``predicted``.

    A null text is an empty one and is scored too; columns of ``keep`` that are
    named as a result are replaced; ids, ties and repeated rows pass through; an
    empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    out = tuple(c for c in keep if with_text or c != "text")
    kept = docs.select(*dict.fromkeys((*keep, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in out) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        scorer = model.scorer()
        for batch in batches:
            p = np.clip(scorer(batch.column("text")), 0.0, 1.0)
            names = [n for n in batch.schema.names if n in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id):
    return crc_fold(doc_id) == 0
