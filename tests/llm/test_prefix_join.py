import random

import numpy as np
import pyarrow as pa
import pytest

from gridtide.llm import prefix_join


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=80):
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        known = [v for v in (i, least.get(find(k))) if v is not None]
        least[find(k)] = min(known) if known else None
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def edited(text, k, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = f"new{rng.randrange(200)}"
    return " ".join(words)


def corpus():
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \t\n", "one two", "One  TWO", "one two three", "x " * 4000]
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 120, 300)))) for _ in range(8)]
    texts += base + [edited(b, k, rng) for b in base for k in (1, 2, 3, 6, 9, 15)]
    hub = " ".join(f"h{i}" for i in range(120))
    texts += [edited(hub, rng.randrange(1, 8), rng) for _ in range(60)] + [hub] * 5
    texts += [passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.choice((8, 12, 20)))) for _ in range(40)]
    texts += [" ".join(b.split()[: len(b.split()) * 9 // 10]) for b in base] + [b.upper() for b in base]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 50])
def test_components_equal_brute_force(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = prefix_join.jaccard_groups(docs, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, percent)


def test_candidates_hold_every_link_whatever_the_counts_say(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(prefix_join, "shingle_counts", lambda *_: (np.full(1 << prefix_join.BUCKET_BITS, 900, np.uint16), 2.0))
    got = prefix_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_prefix_grows_with_the_cost_of_its_candidates():
    hashes = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 100, dtype=np.uint64))
    counts = np.ones(1 << prefix_join.BUCKET_BITS, np.uint16)
    assert prefix_join.prefix(hashes, counts, 0.0) [:2] == (1, 21)
    counts[prefix_join._bucket(hashes)] = 5000
    matches, alone, tokens = prefix_join.prefix(hashes, counts, 0.0)
    assert matches == prefix_join.MOST_MATCHES and alone == 0 and len(tokens) == 20 + matches


def test_null_and_repeated_ids_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1, "a"), (None, text, 2, "b"), (4, text + " end", 3, "c"), (4, text, 3, "c"), (9, "", 1, "d"), (None, None, 1, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, node string")
    got = sorted((tuple(r) for r in prefix_join.jaccard_groups(docs).collect()), key=repr)
    assert got == sorted([(None, 46, 4), (None, 46, 4), (4, 47, 4), (4, 46, 4), (9, 0, 9), (None, 0, None)], key=repr)
    assert prefix_join.jaccard_groups(docs.limit(0)).collect() == []


def test_sets_and_sketches_of_a_large_batch_come_in_parts():
    texts = [None, "", "a b", *(" ".join(f"w{i}x{j}" for j in range(900)) for i in range(1000)), "long " * 500000, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["cid", "text"])
    parts = list(prefix_join._sets(5)(iter([batch])))
    assert [c for p in parts for c in p.column(0).to_pylist()] == list(range(len(texts)))
    found = [s for p in parts for s in p.column(1).to_pylist()]
    assert all(s == prefix_join.shingles((t or "").encode()).view(np.int64).tolist() for s, t in zip(found, texts))
    assert max(p.nbytes for p in parts) < 2 << 20

    class Shared:
        value = (np.ones(1 << prefix_join.BUCKET_BITS, dtype=np.uint16), 0.5)

    rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).cast(pa.string()), batch.column(1)], ["doc_id", "row_key", "text"])
    sketched = list(prefix_join._sketch(5, 80, Shared, None)(iter([rows])))
    assert [i for p in sketched for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [n for p in sketched for n in p.column(3).to_pylist()] == [len(s) for s in found]
    assert len(sketched) == len(parts) > 5


def test_postings_stay_out_of_the_driver(spark, monkeypatch):
    from gridtide.llm.near_copies import fingerprint_pairs

    plans = {}

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    settle = prefix_join.settle
    monkeypatch.setattr(prefix_join, "settle", watched)
    rows = [(i, " ".join(f"w{(i // 3) * 40 + j}" for j in range(40)) + f" end{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = prefix_join.jaccard_groups(docs, seeds=fingerprint_pairs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i // 3 * 3) for i in range(30)}
    for name in ("postings", "hub_pairs", "live_postings"):
        assert "SortMergeJoin" in plans[name] and "BroadcastExchange" not in plans[name]
