"""A training-corpus pipeline: five stages over `documents`, each one operator of lamella.llm.

Stages: quality classifier (rejected documents go), language ID (rejected documents go), n-gram
Jaccard join on five words at 0.8 (one document of each group stays), mixing sources to target
weights (documents repeat as often as the mix takes them), packing (token pieces in sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import jaccard, language, mixing, packing, quality
from lamella.llm.catalog import table, tokenizer_file
from lamella.llm.common import cut, drop_written, scratch, written

#: Sources up to this number are broadcast with their share of the mix; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Words that packing remembers in a worker, in one task: executors still hold what the stages before
#: have grown to, and later work needs the workers' memory.
PACKING_MEMORY_WORDS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is 0.7 or more; all columns stay.

    The classifier is fitted on documents with a label in `labels` (about quality.LABELLED_ROWS of them at
    most, drawn by a hash of the id), so every text is described once. Null and empty texts have a score like
    any other; rows with a null id are scored but never learnt from; repeated rows and ties are scored each.
    Without usable labels all scores are 0.5 and nothing stays. An empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(cut(quality.describe(quality.labelled(docs, labels))), labels)
    return quality.keep(docs, model, 0.7)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject; all columns stay.

    Null texts, empty ones and those without a letter go, as do texts far from every centroid. Rows with a null
    id or lang are judged but not learnt from; repeated rows and ties are judged each. With nothing to learn
    from nothing stays. An empty table gives an empty one.
    """
    return language.keep(docs, language.fit(docs))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked on five words at 0.8, that with the smallest id; all columns stay.

    Ids play no other part: rows of one id with different texts are documents of their own, and rows with
    the same id and text are one. Rows with a null id stay, as do those without words (once for each id and
    text). An empty table gives an empty one.
    """
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); all columns stay.

    A null source is a source of its own. Null and empty texts have no words, so they add nothing to their
    source's target and are repeated like the others of it; a null id counts as the word "null"; rows that are
    equal in id, text and source have the same place and go together. An empty table gives an empty one.
    """
    marks = cut(mixing.marks(docs))
    return mixing.repeat(docs, F.broadcast(marks) if marks.count() <= BROADCAST_SOURCES else marks)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' tokens in sequences of at most 4096.

    Null and empty texts are the end id alone; null ids and repeated rows are packed like any others, each
    repetition by itself; equal pieces are dealt in any order. An empty table gives an empty result. Columns
    are those of packing.pack, others of docs are not read.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), memory_words=PACKING_MEMORY_WORDS, keep=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", join_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the pipeline against its parts and brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages in turn over sf_dir's documents.

    Each stage but the last is written to the shared folder, after which what it had cut and what it read goes.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs, now = written(stage(spark, docs, sf_dir))
        if path is not None:
            drop_written(spark, path)
        path = now
    docs = STAGES[-1][1](spark, docs, sf_dir)
    if path is not None:  # the last stage cuts its pieces when called
        drop_written(spark, path)
    return docs
