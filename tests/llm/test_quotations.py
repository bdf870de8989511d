from gridtide.llm import quotations as q

SCHEMA = "conv_id long, turn long, role string, text string, root string"


def threads(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in q.reply_ordered(df).collect()}


def test_nested_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "a", "First question\nover two lines."),
        (1, 1, "b", "An answer.\n\nSecond paragraph."),
        (1, 2, "c", "> An   ANSWER.\n\nI disagree."),
        (1, 3, "d", "On Monday b wrote:\n> second paragraph.\n>> First question over\n>> two lines.\nFine."),
        (1, 4, "e", ">> First question\n>> over two lines.\nOnly the nested one."),
        (1, 5, "f", "> never said\nUnknown quote."),
        (1, 7, "g", "After a gap."),
        (2, 0, "a", "> An answer.\nOther conversation."),
    ]
    got = threads(spark, rows)
    links = {k: (r.reply_to, r.root, r.depth, r.n_quoted, r.n_linked) for k, r in got.items()}
    assert links == {
        (1, 0): (None, 0, 0, 0, 0),
        (1, 1): (0, 0, 1, 0, 0),
        (1, 2): (1, 0, 2, 1, 1),
        (1, 3): (1, 0, 2, 2, 2),
        (1, 4): (0, 0, 1, 1, 1),
        (1, 5): (4, 0, 2, 1, 0),
        (1, 7): (None, 7, 0, 0, 0),
        (2, 0): (None, 0, 0, 1, 0),
    }
    assert got[(1, 3)].text == "Fine." and got[(1, 1)].text == "An answer.\n\nSecond paragraph."
    assert got[(1, 2)].text == "I disagree."


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "b", ""), (1, 1, "b", ""), (1, 2, "c", ">"), (None, 3, "d", "x"), (4, None, "e", "> x"), (5, 9, "f", "w " * 100000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = q.reply_ordered(df).collect()
    assert len(got) == len(rows)
    assert sorted(((r.conv_id, r.turn, r.root, r.depth) for r in got), key=str) == sorted(
        [(1, 0, 0, 0), (1, 1, 0, 1), (1, 1, 0, 1), (1, 2, 0, 2), (None, 3, 3, 0), (4, None, None, 0), (5, 9, 9, 0)], key=str
    )
    assert q.reply_ordered(df.limit(0)).collect() == []


def test_long_chains_and_repeated_passages(spark):
    rows = [(1, t, "r", f"text {t}\n> text {t - 1}" if t else "text 0") for t in range(70)]
    rows += [(2, t, "r", "same words" + ("\n> same words" if t else "")) for t in range(30)]
    got = threads(spark, rows)
    assert all(got[(1, t)].depth == t and got[(1, t)].root == 0 for t in range(70))
    assert all(got[(2, t)].reply_to == t - 1 for t in range(1, 30))


def test_order_over_partitions(spark):
    df = spark.createDataFrame([(c, t, "r", "hi") for c in range(20) for t in range(5)], "conv_id long, turn long, role string, text string")
    order = [(r.conv_id, r.root, r.depth, r.turn) for r in q.reply_ordered(df).collect()]
    assert order == sorted(order)


def test_the_query_needs_its_links(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    found = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked) for r in q.op4_quotation_links(spark, folder).collect()}
    counts = [sum(v[k] > 0 for v in found.values()) for k in (1, 2)]
    assert 0 < counts[1] < counts[0] and any(v[1] == 2 for v in found.values())
    assert any(v[0] is not None and v[0] < k[1] - 1 for k, v in found.items())
    links = q.quote_links
    monkeypatch.setattr(q, "quote_links", lambda p: links(p).where("FALSE"))
    without = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked) for r in q.op4_quotation_links(spark, folder).collect()}
    assert sum(found[k][0] != without[k][0] for k in found) > len(found) / 4
