import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridtide.llm import quality

SF = "/root/testdata/sf0.01"


def test_odd_texts_have_figures():
    for text in (None, "", " ", "a", "a " * 50000, "\x00", "É" * 1000, "|||"):
        figures = quality.statistics(text)
        assert len(figures) == len(quality.STATISTICS) and np.isfinite(figures).all()
    assert quality.statistics(None) == quality.statistics("")


def test_isotonic_is_the_least_squares_rise():
    rng = np.random.default_rng(0)
    x, y, w = np.arange(30.0), rng.random(30), rng.integers(1, 5, 30).astype(float)
    centres, levels = quality.isotonic(x, y, w)
    assert (np.diff(centres) > 0).all() and (np.diff(levels) > 0).all()
    # every block is a weighted mean, and max-min formula gives the same level at each point
    best = [
        max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 30)) for a in range(i + 1))
        for i in range(30)
    ]
    assert sorted(set(np.round(levels, 9))) == sorted(set(np.round(best, 9)))


def test_partition_sums_are_the_normal_equations():
    rng = np.random.default_rng(1)
    z, y = rng.normal(size=(80, 6)), rng.normal(size=80)
    full = np.hstack([z, y[:, None]])
    total = full.T @ full
    i, j = np.triu_indices(7)
    weights = quality.solve(np.column_stack([i, j, total[i, j]]), 7)
    assert np.allclose((z.T @ z + quality.RIDGE * np.eye(6)) @ weights, z.T @ y)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.op1_quality_fourier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    right = [r.predicted == labels[r.doc_id] for r in held if r.doc_id in labels]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


@pytest.mark.parametrize("labelled", [[], [(1, 1), (1, 0), (None, 1), (2, None)]])
def test_few_labels_and_odd_rows(spark, labelled):
    docs = spark.createDataFrame([(1, "a b", 2), (None, None, 3), (1, "a b", 2), (2, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def test_features_of_a_large_batch_are_held_in_parts():
    rng = np.random.default_rng(2)
    held = []

    class Watched(quality.Features):
        def __call__(self, x):
            held.append(len(x))
            return super().__call__(x)

    size = len(quality.STATISTICS)
    features = Watched(np.zeros(size), np.ones(size))
    x, label = rng.normal(size=(5000, size)), rng.integers(0, 2, 5000).astype(float)
    whole = np.hstack([quality.Features(np.zeros(size), np.ones(size))(x), label[:, None]])
    batch = pa.RecordBatch.from_arrays([*map(pa.array, x.T), pa.array(label)], [*quality.STATISTICS, "label"])
    (sums,) = quality._sums(features)(iter([batch]))
    assert np.allclose(sums.column("value").to_numpy(), (whole.T @ whole)[np.triu_indices(len(whole.T))])
    weights = rng.normal(size=quality.FOURIER + 1)
    assert np.allclose(quality.Model(features, weights).raw(x), whole[:, :-1] @ weights)
    assert len(quality.Model(features, weights).raw(x[:0])) == 0
    assert sum(held) == 10000 and max(held) <= 1024
