import random

import numpy as np
import pytest

from gridtide.llm import token_rows as tr


def test_best_fit_takes_the_fullest_row():
    rng = random.Random(2)
    for room in (1, 7, 64, 100):
        for n in (0, 1, 50, 300):
            sizes = [rng.randint(0, room) for _ in range(n)]
            rows = tr.best_fit(sizes, room)
            free, want = [], []
            for piece in sorted(range(n), key=lambda i: -sizes[i]):
                fitting = [f for f in free if f >= sizes[piece]]
                if fitting:
                    free[free.index(min(fitting))] -= sizes[piece]
                else:
                    free.append(room - sizes[piece])
                want = sorted(free)
            assert sorted(room - sum(sizes[i] for i in r) for r in rows) == want
            assert sorted(i for r in rows for i in r) == list(range(n))


@pytest.fixture(scope="module")
def encoding():
    with open(tr.VOCABULARY, "rb") as file:
        return tr.encoder(file.read())


def test_round_trip(spark, encoding):
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice(("word", "éàü", "<|endoftext|>", "12", "\n\n", "日本")) for _ in range(rng.randint(0, 90))) for i in range(80)}
    texts |= {900: None, 901: "", 902: "long " * 3000, 903: "x" * 4000}
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, pieces int")
    found: dict = {}
    for r in tr.token_rows(docs.repartition(3), row_tokens=64).collect():
        ids = np.frombuffer(bytes(r.ids), dtype="<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens == 64 - r.n_pad
        assert (ids[r.n_tokens :] == tr.PAD_ID).all() and r.position_resets == r.cu_seqlens[:-1]
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (doc, piece) not in found
            found[doc, piece] = ids[a:b].tolist()
    for i, t in texts.items():
        pieces = [found[k] for k in sorted(found) if k[0] == i]
        assert encoding.decode([x for p in pieces for x in p]) == (t or "")
        assert all(len(p) == 64 for p in pieces[:-1])


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    ids = [i for r in tr.token_rows(docs).collect() for i in r.doc_ids]
    assert sorted(ids, key=str) == [1, 1, None]
    assert tr.token_rows(docs.limit(0)).collect() == []


def test_large_vocabularies_take_four_bytes(spark, tmp_path):
    import base64

    singles = [(bytes([b]), b) for b in range(256)]
    path = tmp_path / "large.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {n}" for t, n in [*singles, (b"ab", 70000), (b" ab", 200000)]))
    assert tr.id_kind(path.read_bytes()).itemsize == 4
    docs = spark.createDataFrame([(1, "ab ab c")], "doc_id long, text string")
    row = tr.token_rows(docs, str(path), row_tokens=8).first()
    assert row.id_bytes == 4 and np.frombuffer(bytes(row.ids), "<u4")[:4].tolist() == [70000, 200000, 32, 99]
    assert tr.token_rows(docs, row_tokens=8).first().id_bytes == 2
