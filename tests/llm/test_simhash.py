import random

import numpy as np
import pytest
import xxhash

from gridtide.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C d É é x\x0by", "x " * 70000, "Ab\x1fc d e"])
def test_fingerprint_of_odd_texts(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_every_close_word_shares_a_codeword():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 300)
    own, _, _ = simhash.codeword_indices(words)
    for bit in range(23):
        mine, near, has = simhash.codeword_indices(words ^ (1 << bit))
        assert ((mine == own) | (has & (near == own[:, None]).any(axis=1))).all()


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for k in (1, 2, 3, 4):
            for _ in range(3):
                q = p
                for bit in rng.sample(range(64), k):
                    q ^= 1 << bit
                prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "print long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_and_prints_stay_out_of_the_driver(spark, tmp_path):
    spark.range(500).selectExpr("xxhash64(id) AS print").write.parquet(f"{tmp_path}/prints")
    docs = spark.createDataFrame([(i, f"w{i % 7} and others {i % 5}") for i in range(60)], "doc_id long, text string")
    for found in (simhash.near_pairs(spark.read.parquet(f"{tmp_path}/prints")), simhash.simhash_groups(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_of_odd_rows(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(200)) for _ in range(6)]
    texts = [None, "", "  "] + base + base[:2] + [b + " tail" for b in base] + [b.replace("beta", "beto", 1) for b in base]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, print string"))
    prints = {i: brute_print(t) for i, t, _ in rows}
    want = brute_components(prints)
    assert {(r.doc_id, r.print % (1 << 64), r.component_id) for r in got.collect()} == {(i, prints[i], want[i]) for i in prints}


def test_empty_table_and_null_ids(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "only here now"), (5, "a b c"), (5, "a b c")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(5, 5), (5, 5), (None, None)]


def test_chains_and_stars_are_one_component(spark):
    from gridtide.llm.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
