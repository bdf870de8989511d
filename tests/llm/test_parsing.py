import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridtide.llm import parsing


def brute(rows):
    """Results by comparing all windows; rows are (id, text)."""
    first = {}
    data = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for at in range(len(t) - 99):
            w = t[at : at + 100]
            first[w] = min(first.get(w, (i, at)), (i, at))
    out = []
    for (given, _), (i, t) in zip(rows, data):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for at in range(len(t) - 99):
            if first[t[at : at + 100]] < (i, at):
                gone[at : at + 100] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((given, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, id string, at int")
    got = parsing.repeated_spans(docs.repartition(parts)).collect()
    assert {r.row.id for r in got} <= {"x"}
    return sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)


def sentences(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("hot", [parsing.HOT_PHRASES, 3, 0])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(parsing, "HOT_PHRASES", hot)
    rng = random.Random(11)
    shared = [sentences(rng, n) for n in (18, 25, 40, 60, 120)]
    rows = [(None, shared[3] + " x"), (1, None), (2, ""), (3, "short"), (4, "a" * 400), (5, "a" * 99), (6, "a" * 100)]
    for i in range(40):
        parts = [sentences(rng, rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 60) :])
        rows.append((100 - i, " ".join(parts)))
    whole = sentences(rng, 200)
    rows += [(200, whole), (201, whole), (202, whole[:600] + "Z" + whole[600:]), (7, "ab" * 300), (8, "xyz" * 100 + "ab" * 200)]
    rows += [(300, whole[:500]), (300, whole[:500]), (300, whole[100:900])]
    assert run(spark, rows) == brute(rows)


def test_long_texts_are_cut_between_windows(spark, monkeypatch):
    rng = random.Random(2)
    text = sentences(rng, 400)
    rows = [(1, text), (2, "q" + text[37:1200] + "w"), (3, text[700:])]
    whole = run(spark, rows, 1)
    assert whole == brute(rows)
    monkeypatch.setattr(parsing, "PIECE", 150)
    one = parsing.phrases([t.encode() for _, t in rows])
    assert one[4].sum() == sum(len(t.encode()) - 99 for _, t in rows)


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_groups_of_triggers_are_never_cut(monkeypatch, size):
    monkeypatch.setattr(parsing, "GROUP_PHRASES", size)
    rows = [(t, i, 0, 5 * i, [i % 3, 9, i]) for t, k in ((-4, 3), (2, 1), (5, 6), (8, 2)) for i in range(k)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["trigger", "id", "tag", "at", "names"]
    )
    got = [r for out in parsing._grouped([batch.slice(0, 4), batch.slice(4)]) for r in out.to_pylist()]
    want = set()
    for t, i, _, at, found in rows:
        for k, name in enumerate(found):
            places = [(j, a + m) for u, j, _, a, f in rows if u == t for m, other in enumerate(f) if other == name]
            if min(places) < (i, at + k):
                want.add((t, i, at + k))
    assert sorted((r["id"], r["at"] + k) for r in got for k in range(r["n"])) == sorted((i, a) for _, i, a in want)


def test_cut_texts_and_lengths(spark):
    rng = random.Random(4)
    text = sentences(rng, 50)
    docs = spark.createDataFrame([(1, text, 5), (2, text + "!", 5), (3, None, 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in parsing.without_repeats(docs).collect()}
    assert got == {1: (text, len(text)), 2: ("!", 1), 3: (None, 0)}


def test_empty_table(spark):
    assert run(spark, [(1, "a")]) == brute([(1, "a")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert parsing.repeated_spans(empty).collect() == []
