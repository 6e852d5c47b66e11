"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage works on all that the one
before it kept; all but the last return the columns of ``documents``, whatever
other columns come in.  Null texts count as empty and stay null; rows of a null id
are judged by their text and never dropped as copies; rows that share an id share
the near-duplicate stage's decision and are judged one by one elsewhere; empty
tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, neardup, packing, pii, toxicity
from .common import docs_table, release, written

#: Ids that may be sent to every task: 8 MB.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject; learned from the labelled rows outside fold 0."""
    model = toxicity.train(docs, docs_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS, with_text=True).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id; a null id stays.

    The ids to drop are few and narrow: up to ``BROADCAST_IDS`` they are sent to
    all tasks and no text moves; beyond, the texts are shuffled once.
    """
    found = neardup.near_duplicates(docs)
    kept = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"))
    dropped = written(kept.where("not kept").select("doc_id"), "dropped", rows=docs.count())
    release(*found._held)
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; dropped in the pass that scans them."""
    return decontam.uncontaminated(docs, docs_table(spark, sf_dir, "benchmark"), keep=COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.detect(docs, keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Models, fingerprints and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's table goes when the next one's is written."""
    docs, before = docs_table(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
