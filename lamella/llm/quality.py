"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut, fold, held_out, split_words, text_blocks, text_rows

#: Random features of the Gaussian kernel.
FOURIER = 256
#: Partial sums that reach the driver at most, and that one task adds up.
PARTIAL_SUMS = 8
FAN_IN = 32
#: Score bins of the calibration.
BINS = 1000
#: Share of the score that follows the regression itself, so that texts on one step of the calibration keep their order.
ORDERED = 0.02
#: Labelled documents that `labelled` picks at most, about.
LABELLED_ROWS = 500_000


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of document statistics per text (no nulls), each roughly between -3 and 3."""
    words, offsets = split_words(texts)
    n = len(texts)
    count = np.diff(offsets).astype(np.float64)
    safe = np.maximum(count, 1)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.empty(0)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary
    odd = pc.match_substring_regex(distinct, r"[^\p{L}\p{N}]{2,}").to_numpy(zero_copy_only=False)
    bare = pc.match_substring_regex(distinct, r"^[^\p{L}\p{N}]+$").to_numpy(zero_copy_only=False)
    upper = pc.match_substring_regex(distinct, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$").to_numpy(zero_copy_only=False)
    title = pc.match_substring_regex(distinct, r"^\p{Lu}\p{Ll}").to_numpy(zero_copy_only=False)
    digit = pc.match_substring_regex(distinct, r"[0-9]").to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(distinct, r"[.!?,;:]$").to_numpy(zero_copy_only=False)
    marked = pc.match_substring_regex(distinct, r"[^\p{L}\p{N}.,;:'-]").to_numpy(zero_copy_only=False)
    same = np.concatenate(([0.0], (ids[1:] == ids[:-1]).astype(np.float64))) if len(ids) else np.empty(0)
    starts = offsets[:-1][count > 0]
    if len(starts):
        same[starts] = 0
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pair = owner * max(1, len(distinct)) + ids
    values, often = np.unique(pair, return_counts=True)
    of = values // max(1, len(distinct))
    kinds = np.bincount(of, minlength=n).astype(np.float64)
    most = np.zeros(n)
    np.maximum.at(most, of, often)
    squares = np.bincount(of, weights=often.astype(np.float64) ** 2, minlength=n)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    some = np.maximum(chars, 1)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1.0
    marks = [pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False) / some for p in (r"\p{Lu}", r"[^\p{L}\p{N}\s]", r"[0-9]", r"[.!?]")]
    mean = total(lengths) / safe
    columns = [
        np.log1p(count) / 4,
        mean / 5,
        np.sqrt(np.maximum(0, total(lengths.astype(np.float64) ** 2) / safe - mean**2)) / 4,
        kinds / safe,
        most / safe * 4,
        np.sqrt(squares) / safe * 4,
        total(same) / safe * 4,
        *(total(x[ids].astype(np.float64)) / safe * 2 for x in (odd, bare, upper, title, digit, ended, marked)),
        np.log1p(lines) / 3,
        lines / safe * 4,
        *(4 * m for m in marks),
        (count == 0).astype(np.float64),
    ]
    return np.clip(np.stack(columns, axis=1), -3, 3)


@dataclass
class Model:
    """A fitted scorer; without labels every score is `prior`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray
    seed: int
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.seed) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        within = 1 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))
        return np.clip((1 - ORDERED) * np.interp(raw, self.steps_at, self.steps) + ORDERED * within, 0, 1)


def fourier(x: np.ndarray, seed: int) -> np.ndarray:
    """cos features whose inner products approximate exp(-|x - y|^2 / (2 d)), a constant, and x itself."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    directions = rng.standard_normal((d, FOURIER)) / np.sqrt(d)
    phases = rng.uniform(0, 2 * np.pi, FOURIER)
    return np.concatenate((np.sqrt(2 / FOURIER) * np.cos(x @ directions + phases), np.ones((len(x), 1)), x / np.sqrt(d)), axis=1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value in weighted squares: pool adjacent violators."""
    pooled: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pooled.append([v, w, 1])
        while len(pooled) > 1 and pooled[-2][0] >= pooled[-1][0]:
            v2, w2, n2 = pooled.pop()
            v1, w1, n1 = pooled.pop()
            pooled.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pooled], [p[2] for p in pooled])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            x = statistics(block.column("text")).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([block.column("doc_id").cast(pa.int64()), flat], names=["doc_id", "x"])

    return text_rows(docs).mapInArrow(run, "doc_id long, x array<float>")


def summed(rows: DataFrame, part: object) -> np.ndarray | None:
    """The sum over all rows of part(x, y), an array: by partition, then in a tree of FAN_IN, at last PARTIAL_SUMS here."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = None
        for pdf in batches:
            if len(pdf):
                new = part(np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["y"].to_numpy(np.float64))
                got = new if got is None else got + new
        if got is not None:
            yield pd.DataFrame({"sum": [got.tobytes()]})

    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = None
        for pdf in batches:
            for b in pdf["sum"]:
                got = np.frombuffer(b) if got is None else got + np.frombuffer(b)
        if got is not None:
            yield pd.DataFrame({"sum": [got.tobytes()]})

    sums, parts = rows.mapInPandas(one, "sum binary"), rows.rdd.getNumPartitions()
    while parts > PARTIAL_SUMS:
        parts = max(PARTIAL_SUMS, -(-parts // FAN_IN))
        sums = sums.repartition(parts).mapInPandas(more, "sum binary")
    found = [np.frombuffer(r[0]) for r in sums.collect()]
    return np.sum(found, axis=0) if found else None


def fit(described: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 11, ridge: float = 1e-3) -> Model:
    """Fit on the rows of described that have a label and whose fold isn't 2.

    Folds 0 and 1 fit the ridge weights, fold 3 the calibration (all three fit both if one is empty).
    Several labels of a document count as their mean; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    rows = cut(described.join(known, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2"))
    moments = summed(rows, lambda x, y: np.concatenate(([len(x), y.sum()], x.sum(axis=0), (x**2).sum(axis=0))))
    none = np.empty(0)
    if moments is None:
        return Model(none, none, none, none, none, seed)
    n, d = moments[0], (len(moments) - 2) // 2
    mean = moments[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 1e-6))
    model = Model(mean, scale, none, none, none, seed, moments[1] / n)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((x - mean) / scale, seed)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y, [len(z)]))

    sums = summed(rows.where("fold < 2"), equations)
    if sums is None:
        sums = summed(rows, equations)
    k = FOURIER + 1 + d
    gram, right = sums[: k * k].reshape(k, k), sums[k * k : -1]
    model.weights = np.linalg.solve(gram + ridge * sums[-1] * np.eye(k), right)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)))

    bins = summed(rows.where("fold = 3"), binned)
    if bins is None:
        bins = summed(rows, binned)
    weight, positive = bins[:BINS], bins[BINS:]
    full = weight > 0
    model.steps_at = (np.flatnonzero(full) + 0.5) / BINS * 2 - 0.5
    model.steps = isotonic(positive[full] / weight[full], weight[full])
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED_ROWS, seed: int = 11) -> DataFrame:
    """The rows of docs to fit on where it costs to describe them all: those whose id has a label.

    Of more than `rows` labelled ids, about so many are drawn by a hash of the id, so the ids can be
    broadcast and no text moves. Nulls are left out; repeated rows stay.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = known.count()
    if found > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(rows / found * (1 << 30))))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left_semi")


def score_column(x: Column, model: Model) -> Column:
    shared = model

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(shared.score(np.stack(batch.to_numpy()).astype(np.float64))) if len(batch) else pd.Series([], dtype=float)

    return score(x)


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        block = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])
        parts = [model.score(statistics(b.column("text")).astype(np.float32).astype(np.float64)) for b in text_blocks(iter([block]))]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return text_rows(docs, "*").where(score("text") >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold).

    Scores come from statistics of the whole text alone. Null and empty texts have a score like any
    other (their statistics are zero but for one flag). Rows with a null doc_id are scored but never
    learnt from, and aren't held out; repeated rows are scored each. Without usable labels all scores
    are 0.5; an empty table gives an empty result. Other columns of docs are not read.
    """
    described = cut(describe(docs))
    model = fit(described, labels)
    scored = described.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
