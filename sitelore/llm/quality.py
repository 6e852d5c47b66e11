"""Quality rules as a learned decision list.

Statistics of each text come first (one pass).  Sequential covering then learns
from a bounded sample of labelled statistics: a rule for bad texts grows by the
threshold condition of most FOIL gain, is pruned on rows that it didn't grow on,
and what it covers is removed.  The list is emitted as one ordered Spark
conditional expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, crc_fold, free_memory, hash_sample, written

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SPACES, _SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"

#: The rules' features, each an expression over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: list[str]) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def stats(docs: DataFrame) -> DataFrame:
    """``STATS`` of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            rows = [text_stats(t or "") for t in batch.column("text").to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=[x.split()[0] for x in STATS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, STATS)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it at least, threshold): texts that meet it are bad."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, at_least, limit in self.conditions:
            hit &= (x[name] >= limit).to_numpy() if at_least else (x[name] < limit).to_numpy()
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, limit in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & (value >= F.lit(float(limit)) if at_least else value < F.lit(float(limit)))
        return out


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        out = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, out, -np.inf)


def _grow(x: pd.DataFrame, bad: np.ndarray, most: int) -> Rule:
    rule, inside = Rule(()), np.ones(len(x), bool)
    while len(rule.conditions) < most and (~bad[inside]).any():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best: tuple[float, tuple | None] = (1e-9, None)
        for name in FEATURES:
            values = x[name].to_numpy()[inside]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            cut = np.flatnonzero(np.diff(v)) + 1
            if not len(cut):
                continue
            below = np.cumsum(b)[cut - 1]
            mids = (v[cut - 1] + v[cut]) / 2
            for at_least, p in ((False, below), (True, p0 - below)):
                n = (cut - below) if not at_least else n0 - (cut - below)
                gain = _gain(p0, n0, p.astype(float), n.astype(float))
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, at_least, float(mids[k])))
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        inside = rule.covers(x)
    return rule


def _worth(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> float:
    hit = rule.covers(x)
    return (bad[hit].sum() - (~bad[hit]).sum()) / max(1, hit.sum())


def learn(x: pd.DataFrame, bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """Sequential covering; a rule must be right for at least three of four rows that it covers in the pruning part."""
    rules: list[Rule] = []
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    alive = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[alive & part].any() and (~bad[alive & part]).any():
        grow, prune = alive & part, alive & ~part
        rule = _grow(x[grow], bad[grow], most_conditions)
        if not rule.conditions:
            break
        options = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
        rule = max(options, key=lambda r: _worth(r, x[prune], bad[prune]))
        hit = rule.covers(x)
        checked = rule.covers(x[prune])
        if checked.sum() < 3 or _worth(rule, x[prune], bad[prune]) < 0.5:
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the first rule that holds rejects, else the text is kept."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def labelled_sample(measured: DataFrame, labels: DataFrame, most: int) -> pd.DataFrame:
    """About ``most`` labelled rows outside fold 0, chosen by id hash; a document's labels are averaged."""
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality")).where(crc_fold(F.col("doc_id")) != 0)
    own = hash_sample(own, "doc_id", most)
    features = [F.expr(e).alias(n) for n, e in FEATURES.items()]
    return measured.where(~base_failed()).join(F.broadcast(own), "doc_id").select("quality", *features).toPandas()  # broadcast: about ``most`` rows


def quality_rules(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000) -> tuple[DataFrame, list[Rule]]:
    """Each document's statistics, base verdict and final verdict; and the rules.

    ``train_rows`` bounds the labelled sample; statistics and verdicts cover all
    rows.  A null text has no words and fails the base rule; without labels
    nothing but the base rule rejects; repeated rows each get a row; null ids are
    kept; columns other than doc_id and text are ignored.
    """
    measured = written(stats(docs), "stats")
    sample = labelled_sample(measured, labels, train_rows)
    rules = learn(sample, (sample["quality"] < 0.5).to_numpy()) if len(sample) else []
    out = measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out, rules
