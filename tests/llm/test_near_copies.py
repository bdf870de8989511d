import random

import corpus_pipeline
import pyarrow.parquet as pq

from gridtide.llm import near_copies


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, least[find(k)]) for k, (i, _) in enumerate(rows)}


def edited(text, k, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_near_copies_beyond_three_bits_go(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(8)]
    texts = [None, "", "one two", "One  TWO", *base]
    texts += [edited(b, k, rng) for b in base for k in (1, 3, 6, 9, 30)]
    hub = " ".join(f"h{i}" for i in range(120))
    texts += [edited(hub, rng.randrange(1, 5), rng) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {tuple(r) for r in near_copies.near_copy_groups(docs).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want})


def test_recall_on_the_given_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    got = near_copies.near_copy_groups(spark.read.parquet(path))
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, print string, tags map<string,string>"
    rows = [
        (None, text, "b", {"k": "2"}), (None, text, "a", {"k": "1"}), (3, text + " end", "c", None), (3, text + "  end", "c", None),
        (5, "x y z", "d", None), (5, "x y z", "c", None), (5, "other words here", "d", None),
        (None, "only here", "z", None), (None, "only here", "y", None), (None, "", "e", None), (8, None, "e", None), (9, " ", "e", None),
    ]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, schema))
    assert kept.schema == spark.createDataFrame([], schema).schema
    got = sorted((tuple(r)[:3] for r in kept.collect()), key=repr)
    assert [g for g in got if g[0] == 3] in ([(3, text + " end", "c")], [(3, text + "  end", "c")])
    assert [g for g in got if g[0] != 3] == sorted([(5, "x y z", "c"), (5, "other words here", "d"), (None, "only here", "y"), (8, None, "e")], key=repr)
    assert len(got) == 5


def test_fingerprints_alone_find_the_nearest_copies(spark):
    from gridtide.llm.simhash import fingerprint

    text = " ".join(f"w{i}" for i in range(2000))
    prints = [fingerprint(t.encode(), 5) for t in (text, text + " end", text.replace("w7 ", "x7 "))]
    rows = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)] + [(3, 12345), (4, 12345)]
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame(rows, "cid long, print long"))
    near = {(u, v) for u in range(3) for v in range(u + 1, 3) if 0 < (prints[u] ^ prints[v]).bit_count() <= 3}
    assert near <= {tuple(r) for r in pairs.collect()} and (3, 4) in {tuple(r) for r in pairs.collect()}


def test_empty_table(spark):
    assert near_copies.near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
