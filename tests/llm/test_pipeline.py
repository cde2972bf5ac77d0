import contextlib
import os
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline as pipeline
from lamella.llm import jaccard, language, mixing, packing, quality
from lamella.llm.catalog import queries, tokenizer_file

from .conftest import DOCS
from .test_packing import FILE, verify

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_queries_are_registered():
    assert [k for k, _ in pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert all(sum(n.startswith(f"op{i}_") for n in queries()) == 1 for i in range(1, 11))


@needs_data
def test_run_equals_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    def table(ids):
        return spark.createDataFrame([rows[i] for i in ids], DOCS)

    good = [r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["predicted"]]
    known = [r["doc_id"] for r in language.languages(table(good)).collect() if not r["rejected"]]
    kept = [r["doc_id"] for r in jaccard.link_components(table(known), 5, 80, 100).collect() if r["component_id"] == r["doc_id"]]
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(table(kept)).collect()})
    pieces = pipeline.run(spark, SF).collect()
    verify([(i, rows[i]["text"]) for i, n in copies.items() for _ in range(n)], pieces, 4096)
    assert 0 < len(kept) < len(known) <= len(good) < len(rows)


def test_stages_on_messy_tables(spark, messy, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (messy, empty):
        df = start
        for k, (_, stage) in enumerate(pipeline.STAGES):
            df = stage(spark, df, str(tmp_path))
            if k < 4:
                assert df.columns == start.columns
        df.collect()
    assert pipeline.join_stage(spark, empty, str(tmp_path)).collect() == []


def test_join_stage_keeps_one_of_each(spark, docs, tmp_path):
    text = "one two three four five six seven eight nine ten"
    df = docs((3, text), (1, text), (2, text + "."), (1, text), (None, text), (None, text), (5, ""), (6, None), (7, "other words entirely here now and then"))
    got = Counter(r["doc_id"] for r in pipeline.join_stage(spark, df, str(tmp_path)).collect())
    assert got == Counter({1: 1, 2: 1, None: 2, 5: 1, 6: 1, 7: 1})


def test_join_stage_keeps_a_text_of_its_own_of_a_repeated_id(spark, docs, tmp_path):
    t, u = "one two three four five six seven eight nine ten", "other words entirely here now and then again"
    got = pipeline.join_stage(spark, docs((5, t), (8, t), (8, u)), str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(5, t), (8, u)]


def test_bounded_labels_fit(spark, docs):
    rows = [(i, "the " * (1 + i % 7), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(3, 1, 0), (None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    learnt = {r["doc_id"] for r in quality.labelled(docs(*rows), labels).collect()}
    assert learnt <= set(range(300)) and 200 < len(learnt) < 250
    assert 60 < quality.labelled(docs(*rows), labels, rows=100).count() < 140


def test_stages_leave_nothing_behind(spark, tmp_path, monkeypatch):
    """What stages cut is gone once they are written; the last one's pieces remain."""
    from lamella.llm import common

    made = []
    was = common.scratch

    @contextlib.contextmanager
    def spy():
        with was():
            yield
            made.extend(common._made)

    monkeypatch.setattr(pipeline, "scratch", spy)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(60).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = pipeline.run(spark, str(tmp_path))
    assert made
    for df in made:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        assert not os.path.exists(file.removeprefix("file:"))
    found.collect()


def test_packing_stage_reads_the_tokenizer(docs, spark, tmp_path):
    assert tokenizer_file("word_bpe_49k.json") == FILE
    verify([(1, "a b"), (1, "a b")], pipeline.packing_stage(spark, docs((1, "a b"), (1, "a b")), str(tmp_path)).collect(), 4096)
    assert packing.PIECE_TOKENS <= 4096
