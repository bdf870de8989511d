import hashlib
import math

import numpy as np
import pytest

from gridtide.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """Rows of the contract by plain loops; ``rows`` are ``(vec_id, label, vector)``."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    whole = [[math.floor(256 * x) for x in r[2]] for r in kept]
    width = -(-max(map(len, whole), default=0) // parts)
    whole = [v + [0] * (parts * width - len(v)) for v in whole]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        def near(q, book):
            return min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))

        return [[near(q, books[p]) for p, q in enumerate(v)] for v in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(first)):
                mine = [v[p] for v, f in zip(cut, found) if f[p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[1]] = labels.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), err, labels[r[1]], digest) for r, f, err in zip(kept, found, errors)), key=repr)


@pytest.mark.parametrize("width", [1, 3, 4, 7, 16])
def test_nearest_entries_are_exact(width):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-9, 9, (500, width)), rng.integers(-9, 9, (64, width))
    want = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    chosen, distance = vector_codes.nearest_entries(parts, entries)
    assert (chosen == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_transform_keeps_distances_and_orders_by_sign_changes():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-1000, 1000, (20, 6)) for _ in range(2))
    scaled = ((vector_codes.transformed(a) - vector_codes.transformed(b)) ** 2).sum(axis=1)
    assert (scaled == 8 * ((a - b) ** 2).sum(axis=1)).all()
    basis = vector_codes.walsh_hadamard(np.eye(8, dtype=np.int64))[:, vector_codes.sequency_order(8)]
    assert [(np.diff(c) != 0).sum() for c in basis.T] == list(range(8))


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(i) % 3 if i % 7 else None, rng.normal(size=48).round(2).tolist()) for i in rng.permutation(150)]
    rows += [rows[0], (None, 1, rows[1][2]), (None, None, rows[2][2]), (5000, 1, None), (5001, 1, [1.0, None]), (5002, 1, [float("nan")] * 48)]
    rows += [(5003, 1, [float("inf")] * 48), (-1, 2, []), (-2, 2, [0.5] * 10), (-3, 0, [-0.001] * 50)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")
    got = sorted((tuple(r) for r in vector_codes.vector_codes(docs).collect()), key=repr)
    assert got == brute(rows)


def test_few_vectors_empty_tables_and_too_large_components(spark):
    schema = "vec_id long, label int, embedding array<float>"
    few = [(1, 0, [1.0] * 16), (2, 0, [2.0] * 16), (2, None, [2.0] * 16)]
    got = sorted((tuple(r) for r in vector_codes.vector_codes(spark.createDataFrame(few, schema)).collect()), key=repr)
    assert got == brute(few)
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, 0, [1e30] * 16)], schema))
