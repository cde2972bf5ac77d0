"""Quality and language: held-out accuracy, method checks and messy tables."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import language, quality
from lamella.llm.common import mix64

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LABELS = "doc_id long, quality int, toxic int, score double"


@pytest.fixture
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


@needs_data
def test_quality_held_out(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    right = []
    for r in labels.collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7)
        if g["held_out"]:
            right.append(g["predicted"] == r["quality"])
    assert np.mean(right) > 0.95
    assert len({r["score"] for r in got.values()}) > 0.5 * len(got)  # texts on one step keep their order


@needs_data
def test_held_out_labels_are_not_learned(tables):
    from pyspark.sql import functions as F

    from lamella.llm.common import fold

    docs, labels = tables
    other = labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, other).collect()}
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_quality_messy(messy, empty, spark):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.quality_scores(messy, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0, 0.1), (1, 1, 0, 0.1), (5, 0, 0, None), (7, 0, 1, None), (None, 1, 1, None), (9, None, None, None), (77, 1, 1, 0.0)], LABELS)
    got = quality.quality_scores(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(empty, labels).collect() == []
    one = spark.createDataFrame([(1, 1, 0, 0.1)], LABELS)
    assert len(quality.quality_scores(messy, one).collect()) == messy.count()


def test_fourier_features_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FOURIER", 20_000)
    x = np.random.default_rng(1).standard_normal((6, 4))
    z = quality.fourier(x, 3)[:, :20_000]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 4))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic():
    v, w = np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.2]), np.array([1.0, 1, 2, 1, 1, 3])
    got = quality.isotonic(v, w)
    assert (np.diff(got) >= -1e-12).all() and got @ w == pytest.approx(v @ w)
    assert got.tolist() == pytest.approx([0.1, 0.35, 0.35, 0.35, 0.375, 0.375])


def test_partition_sums_equal_one_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 3))
    df = spark.createDataFrame([(r.tolist(), float(i)) for i, r in enumerate(x)], "x array<double>, y double").repartition(7)
    got = quality.summed(df, lambda a, b: np.concatenate(((a.T @ a).ravel(), a.T @ b)))
    assert np.allclose(got, np.concatenate(((x.T @ x).ravel(), x.T @ np.arange(50.0))))
    assert quality.summed(df.where("false"), lambda a, b: a.sum(axis=0)) is None
    many = df.repartition(70)
    assert np.allclose(quality.summed(many, lambda a, b: a.sum(axis=0)), x.sum(axis=0))


def test_statistics_of_odd_texts():
    got = quality.statistics(pa.array(["", " ", "\n\n", "a" * 100_000, "A!! B!! C!!", "é|ü|ß 1 2"], pa.large_string()))
    assert np.isfinite(got).all() and got[0, -1] == 1 and got[3, -1] == 0


@needs_data
def test_language_held_out(tables):
    docs, _ = tables
    got = {r["doc_id"]: r for r in language.languages(docs).collect()}
    rows = docs.collect()
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(got) == len(rows) and np.mean(right) > 0.97
    assert np.mean([r["rejected"] for r in got.values()]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in got.values())


def training(docs):
    rng = np.random.default_rng(0)
    rows, alphabets = [], {"aa": "abcdefg ", "bb": "hijklmn ", "cc": "äöüßxyz "}
    for lang, letters in alphabets.items():
        rows += [(len(rows), "".join(rng.choice(list(letters), 200)), lang) for _ in range(40)]
    return rows


def test_language_rejects_what_is_far(docs):
    rows = training(docs) + [(900, "жук ель нож шар мир " * 20, None), (901, "abc", None), (902, "", None), (903, None, None), (904, "12 34 !!", None)]
    got = {r["doc_id"]: r for r in language.languages(docs(*rows)).collect()}
    assert got[900]["rejected"] and not got[901]["rejected"] and got[901]["lang_pred"] == "aa"
    for i in (902, 903, 904):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[:120]]) == 1
    kept = {r["doc_id"] for r in language.keep(docs(*rows), language.fit(docs(*rows))).collect()}
    assert kept == {i for i, r in got.items() if not r["rejected"]}


def test_language_messy(messy, empty, docs):
    got = language.languages(messy).collect()
    assert len(got) == messy.count() and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert language.languages(empty).collect() == []
    assert {r["lang_pred"] for r in language.languages(docs((1, "abc"), (2, "def"))).collect()} == {"und"}


def test_ngram_counts_by_hand():
    counts, letters = language.grams(["ab", "a1b", "", "Ab AB"])
    assert letters.tolist() == [2, 2, 0, 4]
    assert counts.sum(axis=1).tolist() == [2 + 3 + 2, 2 + 4 + 3, 0 + 0 + 0, 4 + 6 + 5]


def test_every_language_is_learned(docs):
    """250 languages, each with two letters of its own, and rows of lang `und`, which is a language like any other."""
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for k in range(251):
        lang = f"l{k:03}" if k else "und"
        own = [chr(0x4E00 + 3 * k + i) for i in range(3)] + [" "]
        for _ in range(4):
            truth[len(rows)] = lang
            rows.append((len(rows), "".join(rng.choice(own, 60)), lang))
    rows += [(5000, rows[4][1], "once"), (5001, "цветок " * 9, "alone"), (5002, "цветок " * 8, None)]
    got = {r["doc_id"]: r for r in language.languages(docs(*rows)).collect()}
    taught = {truth[i] for i in truth if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(taught) > 245 and "und" in taught
    assert all(got[i]["lang_pred"] == lang for i, lang in truth.items() if lang in taught and lang != "l001")


def plain_language(rows, texts):
    """idf, centroids and verdicts of a model with one centroid a language, by plain loops."""
    from collections import Counter
    from math import log, sqrt

    def features(text):
        # runs of letters with one space on each side
        out, spaced = Counter(), " "
        for c in f" {text.lower()} ":
            c = c if c.isalpha() else " "
            if c != " " or spaced[-1] != " ":
                spaced += c
        for size in (1, 2, 3):
            for i in range(len(spaced) - size + 1):
                gram = spaced[i : i + size]
                if gram != " ":
                    code = 0
                    for c in gram:
                        code = (code << 21 ^ ord(c)) % 2**64
                    out[int(mix64(np.array([code + size], np.uint64))[0]) % language.FEATURES] += 1
        return out

    train = [(features(t), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    having = Counter(g for f, _ in train for g in f)

    def vector(f):
        v = {g: log(1 + n) * (log((1 + len(train)) / (1 + having[g])) + 0.1) for g, n in f.items()}
        size = sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / size for g, x in v.items()}

    sums = {}
    for f, lang in train:
        for g, x in vector(f).items():
            sums.setdefault(lang, Counter())[g] += x
    for lang, v in sums.items():
        size = sqrt(sum(x * x for x in v.values()))
        sums[lang] = {g: x / size for g, x in v.items()}

    def cosines(f):
        v = vector(f)
        return {lang: sum(x * c.get(g, 0) for g, x in v.items()) for lang, c in sums.items()}

    least = {lang: min(cosines(f)[lang] for f, own in train if own == lang) for lang in sums}
    out = []
    for t in texts:
        near = cosines(features(t))
        lang = max(sorted(near), key=near.get)
        n = sum(c.isalpha() for c in t.lower())
        out.append((lang, near[lang], near[lang] < 0.25 * least[lang] * min(1, n / 200)))
    return out


def test_language_equals_plain_loops(docs, monkeypatch):
    monkeypatch.setattr(language, "CENTROIDS", 1)
    rows = training(docs)[::3]
    texts = [t[:150] for _, t, _ in rows[:30]] + ["abc hij", "äö üx abg", "qrs tuv a", "жук нож " * 30, "a", "ABC DEF! 12 gab"]
    model = language.fit(docs(*rows))
    names, scores, rejected = model.predict(texts)
    for i, (lang, score, far) in enumerate(plain_language(rows, texts)):
        assert scores[i] == pytest.approx(min(1, max(0, score)), abs=2e-3), texts[i]
        if score > 1e-3:
            assert names[i] == lang
        if abs(score) > 1e-3:
            assert bool(rejected[i]) == far


def test_ridge_equals_one_direct_solve(spark):
    """Weights and calibration of fit against the equations of all rows solved at once."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.standard_normal(300) > 0.8).astype(int)
    described = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<float>").repartition(6)
    labels = spark.createDataFrame([(i, int(v), 0, 0.0) for i, v in enumerate(y)], LABELS)
    model = quality.fit(described, labels)
    folds = np.array([zlib.crc32(str(i).encode()) % 4 for i in range(300)])
    learnt = folds != 2
    mean = x[learnt].astype(float).mean(axis=0)
    scale = np.sqrt((x[learnt].astype(float) ** 2).mean(axis=0) - mean**2)
    z = quality.fourier((x[folds < 2] - mean) / scale, 11)
    direct = np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.eye(z.shape[1]), z.T @ y[folds < 2])
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale) and np.allclose(model.weights, direct, atol=1e-6)
    raw = quality.fourier((x[folds == 3] - mean) / scale, 11) @ direct
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(at)
    steps = quality.isotonic(np.array([y[folds == 3][at == b].mean() for b in bins]), np.array([(at == b).sum() for b in bins], float))
    assert np.allclose(model.steps, steps) and np.allclose(model.steps_at, (bins + 0.5) / quality.BINS * 2 - 0.5)
