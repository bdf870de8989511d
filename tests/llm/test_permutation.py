import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridtide.llm import permutation


def brute(rows, queries, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    ids, x = [i for i, _ in good], np.array([v for _, v in good], dtype=float)
    out = {}
    for i, v in good:
        if i in queries:
            score = permutation.cosines(np.array(v, dtype=float), x)
            ranked = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in ranked]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = pq.read_table(path)
    rows = list(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist()))
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    got = answers(permutation.op10_permutation_index(spark, "/root/testdata/sf0.1"))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0]) for i in range(40)] + [(500, [2.0, 4.0, 0.0, 0.0])]
    rows += [(150, None), (200, [0.0] * 4), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 1.0, 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0, 1.0])]
    rows += [(None, [1.0, 0.0, 0.0, 0.0]), (100, [1.0, 2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    want = brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    got = answers(permutation.nearest(df, F.col("vec_id") % 50 == 0, share=1.0, block=16, pivots=8, posted=8))
    assert got == want and 150 not in got


def test_overlap_orders_as_the_footrule_distance():
    rng = np.random.default_rng(1)
    order = np.array([rng.permutation(12)[:7] for _ in range(30)])

    def place(o, p):
        return list(o).index(p) if p in o else 7

    index = permutation.files(order, 12)
    for q in order[:5]:
        distance = [sum(abs(place(q, p) - place(o, p)) for p in range(12)) for o in order]
        assert (7 * 8 - 2 * permutation.overlap(index, q, 30)).tolist() == distance


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [i for i, _ in answers(permutation.nearest(df, F.col("vec_id") % 50 == 0))[0]] == [1]
    assert permutation.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_each_length_is_sought_among_its_own(spark):
    rng = np.random.default_rng(6)
    rows = [(-1, [1.0, 0.0, 0.0])] + [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(permutation.nearest(df, F.col("vec_id") % 50 == 0, share=1.0, posted=64, block=40))
    for size in (8, 5):
        kind = [(i, v) for i, v in rows if len(v) == size]
        want = brute(kind, {i for i, _ in kind if i % 50 == 0})
        assert {q: got[q] for q in want} == want


def test_the_index_skips_most_vectors_and_falls_back_where_few_are_met():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    pivots = x[:1024] / np.linalg.norm(x[:1024], axis=1, keepdims=True)
    order = permutation.orders(x, pivots, 32)
    index = permutation.files(order, len(pivots))
    sizes = [len(permutation.candidates(index, order[i], len(x), 0.6, 6)) for i in range(100)]
    assert 64 <= np.mean(sizes) < 0.45 * len(x)
    lonely = permutation.files(np.array([[0], [0], [1]]), 3)
    assert permutation.candidates(lonely, np.array([2]), 3, 0.6, 2).tolist() == [0, 1, 2]
