import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridtide.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, passage in items:
        w = words_of(passage)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (10, "short éé item"),
    (2, "SHORT ÉÉ item"),
    (3, None),
    (4, " ... "),
    (None, "no id here"),
    (10, "short éé item"),
]
TEXTS = [
    None,
    "",
    "?!",
    "a one-two, THREE four five six seven eight nine ten. Eleven twelve one two three",
    "short éé item short éé item",
    "short Éé item",
    "we have no id here",
    "one two three four five six seven eight nine",
    "x " * 30000 + "short éé item " + "y " * 30000,
    "word" * 5000,
    "short\x00éé\x7fitem",
]


@pytest.mark.parametrize("bound", [dec.BROADCAST_WORDS, 1])
def test_both_ways_find_what_brute_force_finds(spark, bound):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", 7), (None, TEXTS[3], None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string, items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit(1))
    got = dec.find_windows(docs, items, broadcast_words=bound).collect()
    want = sorted(((r[0], *brute(r[1], ITEMS)) for r in rows), key=str)
    assert sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    assert {r.row.n_hit for r in got} == {"x", None}


def test_spans_leave_the_rest(spark):
    docs = spark.createDataFrame([(1, "Ä short éé, ITEM of no id here."), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.row.doc_id: r for r in dec.find_windows(docs, items, want_rest=True).collect()}
    assert got[2].rest is None and got[2].spans == []
    assert got[1].rest == "Ä  of ." and len(got[1].spans) == 2
    assert [r.doc_id for r in dec.drop_contaminated(docs, items).collect()] == [2]


def test_both_ways_give_the_same_spans_and_rest(spark):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (4, TEXTS[3]), (None, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    ways = [dec.find_windows(docs, items, want_rest=True, broadcast_words=n) for n in (dec.BROADCAST_WORDS, 1)]
    assert ways[0].columns == ways[1].columns and ways[0].dtypes == ways[1].dtypes
    few, many = (sorted((tuple(r) for r in way.collect()), key=str) for way in ways)
    assert few == many and any(r[4] for r in many)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dec.find_windows(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dec.find_windows(one, items).first().n_hit == 0


def test_digest_of_no_items(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = dec.op7_decontaminate(spark, str(tmp_path)).first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.contaminated is False


def test_both_ways_take_documents_without_ids_and_with_maps(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    rows = [(f"before {passage} after", {"a": "1"}), ("clean words only", None), (None, {"a": "1"}), (f"before {passage} after", {"a": "2"})]
    docs = spark.createDataFrame([*rows, rows[0]], "text string, tags map<string,string>")
    items = spark.createDataFrame([(1, passage), (2, "never seen here at all")], "item_id long, text string")
    both = [dec.find_windows(docs, items, want_rest=True, broadcast_words=n) for n in (dec.BROADCAST_WORDS, 0)]
    found = [sorted((repr(r) for r in b.collect())) for b in both]
    assert found[0] == found[1] and len(found[0]) == 5
