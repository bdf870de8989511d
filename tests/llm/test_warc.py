import hashlib
import random

import pytest

from gridtide.llm import warc


def brute(rows):
    keeper = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            keeper[h] = max(keeper.get(h, i), i, key=lambda v: -1 if v is None else v)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        k = keeper.get(h)
        again = len(b) >= 1000 and i is not None and k is not None and i < k
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", k if again else None))
    return sorted(out, key=str)


def trip(spark, rows, tmp_path, split="64k"):
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    warc.write_archives(pages.repartition(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return sorted((tuple(r) for r in got), key=str)


def test_round_trip_with_copies_and_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    text = ["".join(rng.choice("<p>é xyz\r\n") for _ in range(n)) for n in (10, 999, 1000, 3000, 60000)]
    rows = [(i, f"http://x/{i}", rng.choice(text)) for i in range(60)]
    rows += [(100, None, None), (101, "a\r\nWARC-Type: x", ""), (102, "", "\r\n\r\n"), (None, "n", text[3]), (-5, "m", text[4])]
    assert trip(spark, rows, tmp_path, "3k") == brute(rows)


def test_magic_in_payloads_is_no_record(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 12\r\n\r\nHTTP/1.1 2\r\n\r\n\r\n\r\n"
    rows = [
        (1, "a", "x" + inner + "y" * 5000 + inner * 3),
        (2, "b", "WARC/1.1\r\n"),
        (3, "c", inner.strip() + "\r\n\r\n"),
        (4, "d", "plain"),
        (5, "e", "WARC/1.1\r\n" * 700),
        (6, "f", "x" + inner + "y" * 5000 + inner * 3),
    ]
    assert trip(spark, rows, tmp_path, "1k") == brute(rows)


def test_empty_table(spark, tmp_path):
    assert trip(spark, [], tmp_path) == []


def archive(*records):
    """Bytes of records ``(version, type, extra head lines, block)``."""
    out = b""
    for version, kind, extra, block in records:
        head = f"WARC/{version}\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode()
        out += head + block + b"\r\n\r\n"
    return out


PAGE = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
INFO = ("1.0", "warcinfo", "Content-Type: application/warc-fields\r\n", b"software: x\r\n")


def page(n):
    return "WARC-Record-ID: <urn:page:%d>\r\n" % n


def test_records_of_all_types_and_versions_are_links_of_the_chain(spark, tmp_path):
    records = [INFO, ("1.0", "response", page(1), PAGE), ("1.1", "request", "", b"GET / HTTP/1.1\r\n\r\n" + b"WARC/1.1\r\nx")]
    records += [("1.1", "metadata", "", b""), ("1.0", "resource", "", b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]
    (tmp_path / "a.warc").write_bytes(archive(*records, ("1.1", "response", page(2), PAGE)))
    (tmp_path / "b.warc").write_bytes(archive(INFO))
    (tmp_path / "c.warc").write_bytes(b"")
    got = sorted(tuple(r) for r in warc.read_archives(spark, str(tmp_path)).collect())
    digest = hashlib.sha1(b"hello").hexdigest()
    assert got == [(n, 5, digest, "response", None) for n in (1, 2)]


def test_a_chain_that_breaks_is_named(spark, tmp_path):
    good = archive(INFO, ("1.1", "response", page(1), PAGE))
    (tmp_path / "good.warc").write_bytes(good)
    (tmp_path / "bad.warc").write_bytes(good + b"garbage" + archive(("1.1", "response", page(2), PAGE)))
    with pytest.raises(ValueError, match=r"bad\.warc after %d of" % len(good)):
        warc.read_archives(spark, str(tmp_path))
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path), allow_broken=True).collect()) == [1, 1]
    (tmp_path / "cut.warc").write_bytes(good[:-10])
    with pytest.raises(ValueError, match="cut.warc"):
        warc.read_archives(spark, str(tmp_path))
