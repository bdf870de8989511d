"""WARC archives: writing pages with revisit records, and reading by a verified chain of record boundaries.

Archives are plain ``WARC/1.1`` files written by Spark's text writer (its line separator is the end mark of a
record). Reading splits the files at every ``WARC/1.``, so any split can be read by itself, but that
may as well stand inside a payload. Therefore each task only emits candidates: the offset of a place that
looks like a record and of the successor that its length calls for. A chain of pointers from offset 0 of a file
decides which are records:

1. Inside a split a task follows successors itself and notes where each candidate's chain leaves the split.
2. Candidates that another split's chain points to, and file starts, are the possible entries, a few for each
   split. Pointer jumping over the entries (each round doubles the jump) marks those that the file start reaches.
3. Each split walks from its reached entry; what it passes are the records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.llm.common import read_table, settle
from gridtide.session import scratch_path

MAGIC = "WARC/1."
#: What follows in the first line of a record, by version.
VERSIONS = (b"0\r\n", b"1\r\n")
PAGE_KINDS = ("response", "revisit")
RECORD_END = "\r\n\r\n"
REVISIT_BYTES = 1000
FILTER_BITS = 1 << 26
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACE = "file string, block long, seq long, at long"
CANDIDATE = (
    f"{PLACE}, length long, next long, leaves long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, whole boolean"
)


def _repeated(ids: DataFrame) -> DataFrame:
    """``(digest, keeper)`` of the payloads that several pages have, with the largest page id."""
    long_ones = ids.where(F.col("size") >= REVISIT_BYTES)
    kept = long_ones.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return settle(kept.where("n > 1").select("digest", "keeper"), "repeated")


def _slot():
    """Place of a digest in the filter, from 1 on."""
    return F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)) + 1


def _filter(kept: DataFrame) -> DataFrame:
    """A bit table of the digests as rows of 4 KB: at most ``FILTER_BITS`` bits, however many digests there are."""
    bits = kept.select(_slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    return bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record for each row of ``pages(page_id, url, html)``.

    Of equal payloads of at least 1000 bytes the one with the largest page id is written as a response; pages with
    smaller ids become revisit records without it. Pages whose digest misses a bit table of the repeated digests are
    written where they are read; only the others are shuffled to learn their part. A null html is an empty payload; a null page id always
    is a response; repeated rows are written as often. Line breaks in an url are percent-encoded.
    """
    whole = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    ids = whole.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    kept = _repeated(ids)
    roles = ids.join(kept, "digest").where("page_id < keeper").select("page_id", "digest", "keeper").distinct()
    tagged = whole.withColumn("digest", F.sha1("html")).withColumn("bucket", F.bitmap_bucket_number(_slot()))
    tagged = tagged.join(F.broadcast(_filter(kept)), "bucket", "left").withColumn("bit", F.bitmap_bit_position(_slot()))
    # the table has a byte for eight bits, the lowest first
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.floor(F.coalesce(byte, F.lit(0)) / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1
    columns = ["page_id", "url", "html", "digest", "keeper"]
    rows = tagged.where(~maybe).withColumn("keeper", F.lit(None).cast("long")).select(*columns)
    rows = rows.union(tagged.where(maybe).join(roles, ["page_id", "digest"], "left").select(*columns))
    revisit = F.col("keeper").isNotNull()
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    refers = F.concat(
        F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">\r\n")
    )
    record = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        identity,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _number(value: bytes | None) -> int | None:
    return int(value) if value and value.isdigit() and len(value) < 19 else None


def _identity(value: bytes | None) -> int | None:
    inner = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(inner) if inner.lstrip(b"-").isdigit() else None


def parse_record(segment: bytes) -> dict | None:
    """Figures of the bytes after a magic, or None if they are no record; ``size`` is up to the next record.

    Records of any type count; those that are no pages have their type and size alone.
    """
    head, mark, _ = segment.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = _number(fields.get(b"content-length"))
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    if not mark or length is None or not kind or not head.startswith(VERSIONS):
        return None
    start = len(head) + 4
    whole = len(segment) >= start + length
    end = segment[start + length : start + length + 4]
    if whole and end != b"\r\n\r\n"[: len(end)]:
        return None
    if kind not in PAGE_KINDS:
        return {"size": start + length + 4, "record_type": kind, "whole": True}
    http, split, payload = segment[start : start + length].partition(b"\r\n\r\n")
    stated = _number(_fields(http).get(b"content-length"))
    found = {
        "size": start + length + 4,
        "page_id": _identity(fields.get(b"warc-record-id")),
        "payload_bytes": stated,
        "payload_digest": fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace"),
        "record_type": kind,
        "refers_to": _identity(fields.get(b"warc-refers-to")),
        "whole": bool(whole and split),
    }
    if kind == "response" and found["whole"]:
        found["payload_bytes"], found["payload_digest"] = len(payload), hashlib.sha1(payload).hexdigest()
    return found


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, with file, split and the bytes themselves; rows of a split stay in order."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """File, split, number within the split, offset of the magic from the split's first byte, and bytes."""
    now, seq, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(c) for c in ("file", "block", "value"))):
            file, block, value = file.as_py(), block.as_py(), value.as_py()
            if (file, block) != now:
                now, seq, at = (file, block), 0, -len(MAGIC)
            yield file, block, seq, at, value
            seq, at = seq + 1, at + len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[dict]) -> pa.RecordBatch:
        place = {r["at"]: r for r in rows}
        for row in reversed(rows):
            following = place.get(row["next"])
            row["leaves"] = row["next"] if following is None or following["next"] is None else following["leaves"]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in CANDIDATE.split(", "))])
    rows: list[dict] = []
    for file, block, seq, at, value in _numbered(batches):
        if rows and (rows[-1]["file"], rows[-1]["block"]) != (file, block):
            yield flush(rows)
            rows = []
        found = parse_record(value) or {}
        size = found.pop("size", None)
        rows.append(
            dict.fromkeys(schema.names)
            | {"file": file, "block": block, "seq": seq, "at": at, "length": len(value) + len(MAGIC)}
            | found
            | {"next": None if size is None else at + len(MAGIC) + size}
        )
    if rows:
        yield flush(rows)


def _walk(key: tuple, table: pa.Table) -> pa.Table:
    """Candidates of one split that the chain from its entry passes."""
    place = {at: i for i, at in enumerate(table.column("at").to_pylist())}
    following, entry = table.column("next").to_pylist(), table.column("entry")[0].as_py()
    passed = []
    while entry in place and following[place[entry]] is not None:
        passed.append(place[entry])
        entry = following[place[entry]]
    return table.take(pa.array(passed, pa.int64())).drop_columns(["entry"])


def reached_entries(pointers: DataFrame) -> DataFrame:
    """``(file, at)`` of the pointers ``(file, at, leaves)`` on the chain from offset 0, by pointer jumping."""
    reached = pointers.where("at = 0").select("file", "at")
    jump = pointers.select("file", "at", F.col("leaves").alias("to"))
    seen = -1
    while (now := reached.count()) != seen:
        seen = now
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        ahead = ahead.join(pointers.select("file", "at"), ["file", "at"], "left_semi")
        reached = settle(reached.union(ahead).distinct(), "reached")
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("after"))
        jump = settle(
            jump.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("after", "to").alias("to")), "jumps"
        )
    return reached


def _joined_payloads(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """Payloads of records with a magic inside, put together from ``parts(file, block, seq, owner, at)``."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, seq, _, value in _numbered(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "seq": seq, "value": value}])

    segments = _segments(spark, path).mapInArrow(numbered, "file string, block long, seq long, value binary")
    pieces = segments.join(parts, ["file", "block", "seq"]).groupBy("file", "owner")
    pieces = pieces.agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("pieces"))

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = parse_record(MAGIC.encode().join(p["value"] for p in row["pieces"])) or {}
                kept = {k: found.get(k) for k in ("payload_bytes", "payload_digest")}
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "owner": row["owner"], **kept}])

    return pieces.mapInArrow(payloads, "file string, owner long, payload_bytes long, payload_digest string")


def broken_files(found: DataFrame, records: DataFrame) -> DataFrame:
    """``file, bytes, reached`` of the files whose chain of records does not go on to their end."""
    sizes = found.groupBy("file").agg((F.sum("length") - len(MAGIC)).alias("bytes"))
    ends = records.groupBy("file").agg(F.max("next").alias("reached"))
    joined = sizes.where("bytes > 0").join(ends, "file", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    return joined.where("reached <> bytes")


def read_archives(spark: SparkSession, path: str, allow_broken: bool = False) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every page record.

    Records are those of versions 1.0 and 1.1; responses and revisits return, all others (such as warcinfo, request or
    metadata) are links of the chain. Digest and size of a response are those of the bytes read; a revisit record
    states both. An empty file has no records. A file whose chain breaks before its end is an error that names it, or
    with ``allow_broken`` gives the records before the break.
    """
    found = settle(_segments(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("file", "block").agg(F.sum("length").alias("bytes"))
    bases = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(by_file), F.lit(0)).alias("base"))
    placed = found.join(bases, ["file", "block"])
    placed = placed.select(
        *("file block seq length page_id payload_bytes payload_digest record_type refers_to whole".split()),
        *((F.col(c) + F.col("base")).alias(c) for c in ("at", "next", "leaves")),
    )
    placed = settle(placed, "placed")
    nodes = placed.where("next IS NOT NULL").select("file", "block", "at", "leaves")
    targets = nodes.select("file", F.col("leaves").alias("at")).distinct()
    entries = nodes.join(targets, ["file", "at"], "left_semi").union(nodes.where("at = 0").select("file", "at", "block", "leaves"))
    entries = settle(entries.distinct(), "entries")
    reached = reached_entries(entries).join(entries, ["file", "at"]).select("file", "block", F.col("at").alias("entry"))
    chosen = placed.join(reached, ["file", "block"])
    records = chosen.groupBy("file", "block").applyInArrow(_walk, placed.schema)
    records = settle(records, "records")
    if not allow_broken:
        broken = broken_files(found, records).orderBy("file").limit(5).collect()  # enough to name some
        if broken:
            names = "; ".join(f"{r.file} after {r.reached} of {r.bytes} bytes" for r in broken)
            raise ValueError(f"The chain of records breaks in {names}")
    records = records.where(F.col("record_type").isin(*PAGE_KINDS))
    result = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    cut = records.where("NOT whole").select("file", F.col("at").alias("owner"), F.col("next").alias("until"))
    if not cut.limit(1).count():
        return records.select(*result)
    in_file = Window.partitionBy("file").orderBy("at")
    owners = placed.join(cut.select("file", F.col("owner").alias("at"), "owner", "until"), ["file", "at"], "left")
    owners = owners.withColumns({c: F.last(c, True).over(in_file) for c in ("owner", "until")}).where("at < until")
    whole = _joined_payloads(spark, path, owners.select("file", "block", "seq", "owner", "at"))
    whole = whole.select("file", F.col("owner").alias("at"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    mended = records.join(whole, ["file", "at"], "left")
    return mended.withColumn("payload_bytes", F.coalesce("b", "payload_bytes")).withColumn(
        "payload_digest", F.coalesce("d", "payload_digest")
    ).select(*result)


def op5_warc_chain(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives and read them back."""
    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT sha1(h) AS d, max(page_id) AS keeper FROM p WHERE strlen(h) >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON sha1(h) = d
"""
