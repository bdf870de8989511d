import hashlib
import importlib
import sys

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_take_effect_and_keep_the_columns(steps):
    docs = steps[0]
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
    counts = [s.count() for s in steps[:-1]]
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] < counts[3]
    assert steps[-1].select("doc_id").distinct().count() == counts[4]


def test_each_stage_does_what_its_operator_says(spark, steps):
    from gridtide.llm import decontaminate, parsing, quality
    from test_near_copies import brute_components

    scores = quality.quality_scores(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.row.doc_id for r in scores if r.score >= 0.5} == {r.doc_id for r in steps[1].collect()}
    groups = brute_components([(r.doc_id, r.text) for r in steps[1].collect()])
    assert {component for _, component in groups} == {r.doc_id for r in steps[2].collect()}
    kept = {r.row.doc_id: r.kept_sha256 for r in parsing.repeated_spans(steps[2]).collect()}
    cut = {r.doc_id: r for r in steps[3].collect()}
    whole = {r.doc_id: r.text for r in steps[2].collect()}
    same = [i for i in cut if cut[i].text == whole[i]]
    assert all(hashlib.sha256((whole[i] or "").encode()).hexdigest() == kept[i] for i in same)
    assert len(same) < len(cut) and all(r.n_chars == len(r.text) for r in cut.values())
    hits = decontaminate.find_windows(steps[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0")
    assert {r.row.doc_id for r in hits.collect()} == {r.doc_id for r in steps[4].collect()}


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a b c " * 40, "en", "s", 240), (3, "a b c " * 40, "en", "s", 240), (None, "x y", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q r s")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}, key=str) == [1, 3, None]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_entry_point_works_without_the_folder(monkeypatch):
    monkeypatch.setitem(sys.modules, "gridtide.llm.queries", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" not in names and len(names) > 100
