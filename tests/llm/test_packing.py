import itertools
import random

import numpy as np

from gridtide.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_pad_least():
    rng = random.Random(1)
    for m in (1, 2, 3, 7, 11):
        lengths = sorted(rng.sample(range(0, 60), m))
        counts = [rng.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5):
            got = packing.best_lengths(np.array(lengths), np.array(counts), k)
            size = min(k, m)
            best = min(
                padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], size - 1)
            )
            assert len(got) == size and padding(lengths, counts, got) == best
    assert packing.best_lengths(np.array([], dtype=int), np.array([], dtype=int)) == []


def test_batches_keep_the_budget_and_every_token(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 90))), "x") for i in range(300)]
    rows += [(None, None, "x"), (None, "a b", "x"), (7, rows[7][1], "x"), (400, "z " * 5000, "x"), (401, "\x0b \t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(docs, buckets=4, max_tokens=64, batch_tokens=500).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert {r.doc_id for r in got} == {r[0] for r in rows} and max(r.n_tokens for r in got) == 64
    slots = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        slots.setdefault((r.bucket, r.bucket_tokens, r.batch), []).append(r.slot)
    last = {}
    for (bucket, length, batch), used in slots.items():
        assert sorted(used) == list(range(len(used))) and len(used) * length <= max(500, length)
        last[bucket] = max(last.get(bucket, 0), batch)
    full = [k for k, used in slots.items() if k[2] < last[k[0]]]
    assert all(len(slots[k]) == max(1, 500 // max(1, k[1])) for k in full)
    pieces = sorted((r.first_token, r.n_tokens) for r in got if r.doc_id == 400)
    assert [a for a, _ in pieces] == [64 * i for i in range(len(pieces))]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
