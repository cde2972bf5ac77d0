"""Language by the nearest of several TF-IDF centroids per language, with distance-based rejection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut, fold, held_out, mix64, text_blocks, text_rows

#: Hashed n-gram features.
FEATURES = 4096
#: Character n-grams of these lengths.
GRAMS = (1, 2, 3)
#: Training rows of each language: centroids are fitted on about this many, drawn by a hash of the id.
ROWS_PER_LANGUAGE = 400
CENTROIDS = 4
#: A text of fewer letters is held to a bound lower in proportion, as its cosine says less.
ENOUGH_LETTERS = 200


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each run of other characters than letters as one space, and the text's offsets."""
    spaced = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in spaced])
    kinds = np.unique(points)
    letter = np.array([chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in kinds.tolist()], bool)
    is_letter = letter[np.searchsorted(kinds, points)]
    points = np.where(is_letter, points, np.uint32(32))
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    kept[:1] = True
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    kept[starts] = True
    counts = np.concatenate(([0], np.cumsum(kept)))
    return points[kept], counts[np.concatenate((starts, [len(points)]))]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (text, feature) of hashed character n-grams, and each text's number of letters."""
    points, offsets = letters(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * FEATURES, np.float32)
    base = points.astype(np.uint64)
    for size in GRAMS:
        if len(base) < size:
            break
        code = base[: len(base) - size + 1].copy()
        for i in range(1, size):
            code = (code << np.uint64(21)) ^ base[i : len(base) - size + 1 + i]
        at = (mix64(code + np.uint64(size)) % np.uint64(FEATURES)).astype(np.int64)
        inside = owner[: len(code)] == owner[size - 1 :]
        if size == 1:
            inside &= points != 32
        out += np.bincount(owner[: len(code)][inside] * FEATURES + at[inside], minlength=n * FEATURES).astype(np.float32)
    letters_of = np.bincount(owner[points != 32], minlength=n)
    return out.reshape(n, FEATURES), letters_of


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    reject_below: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and rejection of each text; texts without letters are `und`."""
        if not len(texts) or not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        names, scores, rejected = [], [], []
        for start in range(0, len(texts), 256):
            counts, n = grams(texts[start : start + 256])
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            names += [self.names[self.of[b]] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
            scores.append(np.where(n > 0, top, 0.0))
            rejected.append((n == 0) | (top < self.reject_below[best] * np.minimum(1, n / ENOUGH_LETTERS)))
        return names, np.concatenate(scores), np.concatenate(rejected)


def spherical_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of the rows of x by cosine; fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ centroids.T).argmax(axis=1)
        for j in range(k):
            if (at == j).any():
                centroids[j] = x[at == j].sum(axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def frequencies(docs: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Rows of each language, and for each feature how many rows have it: summed by partition, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), Counter()
        for block in text_blocks(batches, block_chars=1 << 20):
            rows.update(block.column("lang").to_pylist())
            texts = block.column("text").to_pylist()
            for start in range(0, len(texts), 256):
                total += (grams(texts[start : start + 256])[0] > 0).sum(axis=0)
        yield pa.record_batch([pa.nulls(FEATURES, pa.string()), pa.array(np.arange(FEATURES)), pa.array(total)], names=["lang", "feature", "n"])
        yield pa.record_batch([pa.array(list(rows), pa.string()), pa.nulls(len(rows), pa.int64()), pa.array(rows.values(), pa.int64())], names=["lang", "feature", "n"])

    found = text_rows(docs, "lang", "text").mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES, np.int64)
    for _, feature, n in found:
        if feature is not None:
            out[feature] = n
    return {lang: n for lang, feature, n in found if feature is None}, out


def fit(docs: DataFrame, seed: int = 5, reject_ratio: float = 0.25) -> Model:
    """Learn from rows with text and lang whose fold isn't 2; every value of lang is learned.

    Document frequencies are counted over all those rows. Centroids are fitted in the executors,
    language by language, on a bounded sample of about ROWS_PER_LANGUAGE rows of each, drawn by a hash
    of id and text, copies taken once; a language that the draw leaves without a row is fitted on its row with the first hash.
    The driver gets CENTROIDS centroids a language, so the model grows with the number of languages alone.
    A text is rejected when its cosine is below reject_ratio times the least cosine of the sample's
    rows with the same centroid (less for texts below ENOUGH_LETTERS).
    """
    train = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    rows, having = frequencies(train)
    idf = np.log((1 + sum(rows.values())) / (1 + having)).astype(np.float32) + np.float32(0.1)
    model = Model([], idf, np.empty((0, FEATURES)), np.empty(0, int), np.empty(0))
    if not rows:
        return model
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = spark.createDataFrame([(lang, min(1.0, ROWS_PER_LANGUAGE / n)) for lang, n in rows.items()], "lang string, share double")
    drawn = cut(train.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text").dropDuplicates())
    missed = set(rows) - {r["lang"] for r in drawn.select("lang").distinct().collect()}
    if missed:
        rest = train.join(F.broadcast(spark.createDataFrame([(lang,) for lang in missed], "lang string")), "lang")
        drawn = drawn.unionByName(rest.groupBy("lang").agg(F.min_by("text", F.struct(place, "text")).alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, block_chars=1 << 20):
            texts = block.column("text").to_pylist()
            for start in range(0, len(texts), 128):
                counts, _ = grams(texts[start : start + 128])
                yield pa.record_batch([block.column("lang").slice(start, 128), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "counts"])

    def centred(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(b"".join(sorted(pdf["counts"])), np.float32).reshape(-1, FEATURES)
        if counts.any():  # rows without a letter say nothing about where a language lies
            counts = counts[counts.any(axis=1)]
        x = model.vectors(counts).astype(np.float32)
        found = spherical_means(x, CENTROIDS, seed)
        cosine = x @ found.T
        best = cosine.argmax(axis=1)
        low = [float(cosine[best == j, j].min()) if (best == j).any() else 1.0 for j in range(len(found))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in found], "least": low})

    fitted = text_rows(drawn, "lang", "text").mapInArrow(counted, "lang string, counts binary").groupBy("lang").applyInPandas(centred, "lang string, centroid binary, least double").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    model.names = sorted(rows)
    at = {name: k for k, name in enumerate(model.names)}
    model.centroids = np.stack([np.frombuffer(r["centroid"], np.float32) for r in fitted])
    model.of = np.array([at[r["lang"]] for r in fitted])
    model.reject_below = np.array([reject_ratio * r["least"] for r in fitted])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns lang_pred, score and rejected, computed where each row lies."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores, rejected = model.predict(texts.fillna("").tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    return text_rows(docs, "*").withColumn("guess", guess("text")).select(*[F.col(f"`{c}`") for c in docs.columns], "guess.*")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't rejected, with all their columns."""

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(~model.predict(texts.fillna("").tolist())[2], dtype=bool)

    return text_rows(docs, "*").where(accepted("text"))


def languages(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, rejected.

    Only text is an input of a prediction. Null text and text without a letter are `und`, with score 0,
    and rejected; other texts get a learned language even where rejected (`und` itself, if rows of
    that language are given). Rows with a null doc_id are never learnt from and aren't held out;
    repeated rows are predicted each. With nothing to learn from every row is `und`. An empty table gives an empty result. Other columns of docs are not read.
    """
    model = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text")
