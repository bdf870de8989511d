import hashlib
import itertools
import random
import re
import zlib

import pytest

from gridtide.llm import repair

SPACE = " \t\n\v\f\r"


def brute_edits(rows):
    """Cost, edits and lines of the repair of rows ``(role, text, fault)``, from the last row on."""
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for q in follows:
                for r in set(follows[q]) & set(names):
                    cost, edits, lines = best.get(follows[q][r], (10**6, "", ()))
                    new = (cost + 5, "I" + edits, (names[r] + ":", *lines))
                    best[q] = min(best.get(q, new), new)
        return best

    best = inserted({0: (0, "", ()), 3: (0, "", ())})
    for role, text, fault in reversed(rows):
        before = {}
        for q in follows:
            cost, edits, lines = best[q]
            moves = [(cost + 2, "D" + edits, lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for r, to in follows[q].items():
                    cost, edits, lines = best[to]
                    if role[:1] == r:
                        moves.append((cost + more, "K" + edits, (f"{role}:{text}", *lines)))
                    if r != "s":
                        moves.append((cost + more + 1, "R" + edits, (f"{names[r]}:{text}", *lines)))
            before[q] = min(moves)
        best = inserted(before)
    return best[0]


def brute_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_report(rows):
    """Result for rows ``(turn, role, text)`` in order."""
    faults = brute_faults([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    pairs = zip(rows, rows[1:])
    cost, audit, lines = brute_edits([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def in_order(rows):
    def place(row):
        turn, role, text = row
        return turn is not None, turn or 0, role, hashlib.md5(f"{role}:{text}".encode()).hexdigest()

    return sorted(rows, key=place)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        rule = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if rule:
            new = (conv, turn, "user" if rule == 4 else role, "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text)
            out.extend([new] * (2 if rule == 3 else 1))
    return out


def expected(rows, all_ids):
    groups = {c: [] for c in all_ids}
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    return {c: brute_report(in_order(g)) for c, g in groups.items()}


def got(frame):
    return {r[0]: tuple(r[1:]) for r in (tuple(r) for r in frame.collect())}


@pytest.mark.parametrize("size", range(6))
def test_blocks_give_the_cheapest_and_least_edits(size):
    kinds = [("system", ""), ("user", ""), ("assistant", ""), ("other", ""), ("user", "truncated"), ("system", "truncated"), ("x", "blank")]
    rng = random.Random(size)
    every = list(itertools.product(kinds, repeat=size))
    codes = {"": repair.KEPT, "truncated": repair.CUT, "blank": repair.BLANK}
    for combination in every if len(every) < 3000 else rng.sample(every, 3000):
        rows = [(r, f"t{i}", f) for i, (r, f) in enumerate(combination)]
        symbols = bytes(repair.symbol(r[:1], codes[f]) for r, _, f in rows)
        steps, state, vector, cost = repair.trace(symbols, repair.tables().end, repair.START)
        end = repair.closing(state)
        lines = repair.repaired([r[:2] for r in rows], steps, end[1])
        mine = (cost + repair.tables().vectors[vector][repair.START], "".join(e for e, _ in steps) + end[0], tuple(lines))
        assert mine == brute_edits(rows)


def test_vectors_are_few_and_blocks_are_tabled():
    t = repair.tables()
    assert len(t.vectors) < 100 and t.block.shape == (repair.SYMBOLS**repair.BLOCK_ROWS, len(t.vectors))


def conversations(rng, n):
    texts = ["Yes.", "No!", "And then", " ", "", "Why?\n", "é.", None, "over"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None]
    for conv in range(n):
        for turn in range(rng.randrange(1, 12)):
            yield conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)


@pytest.mark.parametrize("chunk", [repair.CHUNK_ROWS, 3])
def test_reports_equal_brute_force(spark, chunk):
    rng = random.Random(chunk)
    rows = list(conversations(rng, 120))
    rows += [(500, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"c{t}.", ""])) for t in range(700)]
    rows += [(501, 1, "user:a", "Hi."), (501, 2, "user", "a:Hi."), (501, 3, "user", "a:Hi.")]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (7, 1, "user", "Hi."), (7, 1, "user", "Hi.")]
    rng.shuffle(rows)
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rid string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert got(repair.repair(given, chunk)) == expected(filled, {r[0] for r in rows})
        left = brute_damage(rows)
        assert got(repair.repair(repair.damaged(given), chunk)) == expected(left, {r[0] for r in left})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op12_four_russians(spark, path)) == expected(brute_damage(rows), {r[0] for r in rows})


def test_conversations_without_rows_and_empty_tables(spark, tmp_path):
    gone = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(gone, 0, "user", "Hi.")], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(repair.op12_four_russians(spark, str(tmp_path))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(spark.createDataFrame([], schema)).collect() == []
