"""Repeated byte strings across documents by prefix-free parsing.

A rolling hash over 32 bytes sets the triggers: every 100-byte window has one, the leftmost place in it where
the hash is smallest. Neighbouring windows with the same trigger form a phrase, from the start of the first to
the end of the last, so that phrases overlap by 99 bytes and each window lies whole in exactly one of them. The
trigger depends on the bytes of a window alone: equal windows lie in phrases with equal trigger bytes. With this
overlap a suffix of a phrase decides a match by itself, and the parse only has to say which occurrence is first.

1. *Parse*: each text gives its phrases as (trigger, content, place). Of phrases repeated in the texts of a batch only the
   first is compared with others; the rest are known repeats, and a copied text is one row of them.
2. *Dictionary*: phrases are ordered by trigger, content and place. All places of a phrase but the first are
   repeats as a whole. A phrase whose trigger no other phrase has cannot share a window and is left out.
3. *Suffixes*: the first places of the phrases that are left, which are the edges of repeated passages, give
   their dictionary suffixes to a depth of 100 bytes, one row of names for each phrase. Phrases with the same
   trigger meet in one task, which orders their suffixes; all but the first of equal ones are repeats. A trigger
   with more than ``HOT_PHRASES`` phrases sends its suffixes one by one, reduced before the shuffle, instead.

Suffixes and phrases are ordered by 64-bit names (two of them, trigger and content) instead of by letters: the
question is equality to a fixed depth, and names keep the ordered rows at a few bytes where a full suffix
array of the corpus would have to move every suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.common import read_table, settle, slices

DEPTH = 100
TRIGGER_BYTES = 32
PIECE = 1 << 18
PARSE_BYTES = 8 << 20
PLACE_BITS = np.uint64(20)
HOT_PHRASES = 20_000
GROUP_PHRASES = 20_000
NULL_ID = -(1 << 63)
M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)


def _letter_names() -> np.ndarray:
    """A 64-bit name for each byte value, by a counter and a mixing step."""
    z = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * M1
    z = (z ^ (z >> np.uint64(30))) * M2
    return z ^ (z >> np.uint64(31))


LETTERS = _letter_names()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two strings that follow or overlap each other, from their names."""
    z = a * M1
    z += b
    z ^= z >> np.uint64(32)
    z *= M2
    return z


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the 32 bytes, and two names of the 100 bytes, from each place of ``data`` on."""
    h, width = LETTERS[data], 1
    while width < TRIGGER_BYTES:
        h = _pair(h[:-width], h[width:])
        width *= 2
    h64 = _pair(h[: -TRIGGER_BYTES], h[TRIGGER_BYTES:])
    return h, _pair(h64[: 64 - DEPTH], h64[DEPTH - 64 :]), _pair(h64[DEPTH - 64 :], h64[: 64 - DEPTH])


def triggers(h32: np.ndarray) -> np.ndarray:
    """Trigger place of the window from each place on."""
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (h32 & ~low) | np.arange(len(h32), dtype=np.uint64)
    span, width = DEPTH - TRIGGER_BYTES + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    return (np.minimum(least[: len(least) - rest], least[rest:]) & low).astype(np.int64)


def _pieces(texts: list[bytes | None]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about ``PIECE`` bytes; long texts are cut so that no window is."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text or b"") - DEPTH + 1, PIECE):
            part = text[at : at + PIECE + DEPTH - 1]
            if group and size + len(part) > 2 * PIECE:
                yield group
                group, size = [], 0
            group.append((k, at, part))
            size += len(part)
    if group:
        yield group


def phrases(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Trigger name, content name, text, first window and number of windows of each phrase."""
    out: list[tuple[np.ndarray, ...]] = []
    for group in _pieces(texts):
        data = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
        h32, h100, _ = names(data)
        trigger = triggers(h32)
        length = np.array([len(p) for _, _, p in group])
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        count = length - (DEPTH - 1)
        starts = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
        starts = np.unique(np.concatenate((starts, begin)))
        piece = np.searchsorted(begin, starts, side="right") - 1
        inside = starts - begin[piece] < count[piece]
        starts, piece = starts[inside], piece[inside]
        following = np.concatenate((starts[1:], [len(data)]))
        n = np.minimum(following, begin[piece] + count[piece]) - starts
        x = trigger[starts]
        shape = ((x - starts).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        content = _pair(_pair(h100[starts], h100[starts + n - 1]), shape)
        owner = np.array([k for k, _, _ in group])[piece]
        at = starts - begin[piece] + np.array([a for _, a, _ in group])[piece]
        out.append((h32[x], content, owner, at, n))
    if not out:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out))


def _later_places(name: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places come after another place of the same name."""
    order = np.lexsort((at, ids, name))
    head = np.ones(len(order), dtype=bool)
    head[1:] = name[order][1:] != name[order][:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (ids[order] > ids[first]) | (at[order] > at[first])
    return later


def _runs(owner: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row where each run of phrases that follow each other in a text begins, and its number of windows."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + n[:-1])
    starts = np.flatnonzero(new)
    return starts, np.add.reduceat(n, starts) if len(starts) else n


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of a few megabytes of text at a time, and runs of those that these show to be repeats (``known``).

    Known runs need no comparison: they carry a spread name instead of a trigger, so that copies do not meet in a task.
    """
    for batch in batches:
        texts = _texts(batch)
        ids, tags = (batch.column(c).to_numpy() for c in ("id", "tag"))
        for low, high in slices(texts, PARSE_BYTES):
            yield _parsed(texts[low:high], ids[low:high], tags[low:high])


def _parsed(texts: list[bytes | None], ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    trigger, content, owner, at, n = phrases(texts)
    ids, tags = ids[owner], tags[owner]
    known = _later_places(content, ids, at)
    k_ids, k_tags, k_at, k_n, k_owner = (c[known] for c in (ids, tags, at, n, owner))
    starts, lengths = _runs(k_owner, k_at, k_n)
    spread = _pair(k_ids[starts].astype(np.uint64), k_at[starts].astype(np.uint64))
    sent = np.flatnonzero(~known)
    rows = [
        (trigger[sent], spread),
        (content[sent], np.zeros(len(starts), dtype=np.uint64)),
        (ids[sent], k_ids[starts]),
        (tags[sent], k_tags[starts]),
        (at[sent], k_at[starts]),
        (n[sent], lengths),
        (np.zeros(len(sent), dtype=bool), np.ones(len(starts), dtype=bool)),
    ]
    columns = [np.concatenate(pair) for pair in rows]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [_signed(columns[0]), _signed(columns[1]), *(pa.array(c, k) for c, k in zip(columns[2:], kinds))],
        ["trigger", "content", "id", "tag", "at", "n", "known"],
    )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the windows of the phrases listed for each text, one row for each phrase."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "tag", "open"))
        rows, found = [], []
        for doc, tag, places, text in zip(*columns, _texts(batch)):
            for place in places:
                a, n = place["at"], place["n"]
                rows.append((place["trigger"], doc, tag, a))
                found.append(names(np.frombuffer(text[a : a + n + DEPTH - 1], dtype=np.uint8))[1])
        if rows:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(np.concatenate(found)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), lists], ["trigger", "id", "tag", "at", "names"]
            )


def repeated_runs(table: pa.Table) -> pa.RecordBatch:
    """Runs of windows, of phrases given with all others of their triggers, that an earlier place has too."""
    names_ = table.column("names").combine_chunks()
    count = names_.value_lengths().to_numpy()
    name = names_.flatten().to_numpy()
    row = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    ids, at = table.column("id").to_numpy()[row], table.column("at").to_numpy()[row] + within
    trigger = table.column("trigger").to_numpy()[row]
    order = np.lexsort((at, ids, name, trigger))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (name[order][1:] != name[order][:-1]) | (trigger[order][1:] != trigger[order][:-1])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (ids[order] > ids[first]) | (at[order] > at[first])
    begins = later & ~(np.concatenate(([False], later[:-1])) & (within > 0))
    starts = np.flatnonzero(begins)
    run = np.cumsum(begins)[later] - 1
    n = np.bincount(run, minlength=len(starts))
    tags = table.column("tag").to_numpy()[row]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[starts]), pa.array(tags[starts]), pa.array(at[starts], pa.int32()), pa.array(n, pa.int32())],
        ["id", "tag", "at", "n"],
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows from phrases sorted by trigger, some triggers at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP_PHRASES):
            part = batch.slice(at, GROUP_PHRASES)
            held.append(part)
            size += part.num_rows
            if size >= GROUP_PHRASES:
                table = pa.Table.from_batches(held).combine_chunks()
                trigger = table.column("trigger").to_numpy()
                ready = int(np.searchsorted(trigger, trigger[-1]))  # the last trigger may go on
                if ready:
                    yield repeated_runs(table.slice(0, ready))
                held, size = table.slice(ready).to_batches(), len(table) - ready
    if size:
        yield repeated_runs(pa.Table.from_batches(held).combine_chunks())


def _runs_of_hot(windows: DataFrame) -> DataFrame:
    """The same of phrases whose trigger has very many, with the first place of a window found by partial minima."""
    each = windows.select("trigger", "id", "tag", "at", F.posexplode("names").alias("k", "name"))
    each = each.select("trigger", "name", "id", "tag", (F.col("at") + F.col("k")).alias("at"))
    first = each.groupBy("trigger", "name").agg(F.min(F.struct("id", "at")).alias("first"))
    later = each.join(first, ["trigger", "name"]).where(F.struct("id", "at") > F.col("first"))
    return later.select("id", "tag", "at", F.lit(1).alias("n"))


def _kept(text: bytes, places: list[dict] | None) -> tuple[list[bytes], int, int]:
    """What is left of a text, bytes removed, and maximal runs removed."""
    if not places:
        return [text], 0, 0
    starts = np.array([p["at"] for p in places], dtype=np.int64)
    ends = starts + np.array([p["n"] for p in places], dtype=np.int64) + DEPTH - 1
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    begins, stops = starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]
    parts = [text[a:b] for a, b in zip([0, *stops.tolist()], [*begins.tolist(), len(text)])]
    return parts, int((stops - begins).sum()), len(begins)


def _results(want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(_texts(batch), batch.column("spans").to_pylist()):
                parts, removed, spans = _kept(text or b"", places)
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                left = b"".join(parts).decode("utf-8", "ignore") if want_text and text is not None else None
                rows.append((len(text or b""), removed, spans, digest.hexdigest(), left))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(c, type=k) for c, k in zip(columns, kinds))],
                ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _later(df: DataFrame, *names_: str) -> DataFrame:
    """Adds ``repeat``: whether an equal row, by the named columns, has an earlier place."""
    first = F.min(F.struct("id", "at")).over(Window.partitionBy(*names_))
    return df.withColumn("repeat", F.struct("id", "at") > first)


def repeated_spans(docs: DataFrame, want_text: bool = False) -> DataFrame:
    """``row``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, ``kept`` for each document.

    ``row`` holds all columns but ``text``. A byte goes if it is part of a 100-byte string that also starts at a
    smaller id, or at the same id and a smaller offset. Null texts are empty, shorter ones lose nothing. A null
    id counts as smaller than any other. Strings at the same offset of rows with the same id are ties, of which
    neither is earlier. Cuts can split a character; ``kept`` drops its remains, the
    digest keeps them. An empty table gives an empty result.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    repeated_ids = docs.groupBy(key).count().where("count > 1").limit(1).count()
    tag = F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated_ids else F.lit(0).cast("long")
    texts = docs.select(key, tag.alias("tag"), "text", F.struct(*rest).alias("row"))
    parsed = texts.select("id", "tag", "text").mapInArrow(
        _parse, "trigger long, content long, id long, tag long, at int, n int, known boolean"
    )
    by_trigger = Window.partitionBy("trigger")
    dictionary = parsed.repartition("trigger").sortWithinPartitions("trigger", "content")  # the order of both windows
    ordered = _later(dictionary, "trigger", "content").withColumn(
        "shared", F.min("content").over(by_trigger) < F.max("content").over(by_trigger)
    )
    found = ordered.withColumn("repeat", F.col("known") | F.col("repeat")).where("repeat OR shared")
    found = settle(found.drop("content", "known"), "shared_phrases")
    edges = found.where("NOT repeat AND shared").select("id", "tag", "at", "n", "trigger")
    hot = edges.groupBy("trigger").count().where(F.col("count") > HOT_PHRASES).select("trigger")
    of_text = edges.groupBy("id", "tag").agg(F.collect_set(F.struct("at", "n", "trigger")).alias("open"))
    windows = texts.join(of_text, ["id", "tag"]).mapInArrow(
        _suffixes, "trigger long, id long, tag long, at int, names array<bigint>"
    )
    rest_of = windows
    parts = []
    if hot.limit(1).count():
        windows = settle(windows, "windows")
        rest_of = windows.join(hot, "trigger", "left_anti")
        parts.append(_runs_of_hot(windows.join(hot, "trigger", "left_semi")))
    alike = rest_of.repartition("trigger").sortWithinPartitions("trigger")
    parts.append(alike.mapInArrow(_grouped, "id long, tag long, at int, n int"))
    parts.append(found.where("repeat").select("id", "tag", "at", "n"))
    spans = reduce(DataFrame.union, parts).groupBy("id", "tag")
    spans = spans.agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    schema = T.StructType(
        [texts.schema["row"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string").fields]
    )
    return texts.join(spans, ["id", "tag"], "left").mapInArrow(_results(want_text), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; ``n_chars`` follows where it exists."""
    kept = repeated_spans(docs, want_text=True)
    columns = {"text": F.col("kept"), "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long")}
    return kept.select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op3_prefix_free_parsing(spark, sf_dir: str) -> DataFrame:
    """What is removed from every document."""
    spans = repeated_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, coalesce(doc_id, {NULL_ID}) AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
w AS (
  SELECT rn, CAST(id AS HUGEINT) * 4294967296 + i AS place, i, md5_number(substr(h, 2 * i + 1, {2 * DEPTH})) AS k
  FROM (SELECT rn, id, h, unnest(range(0, len(h) // 2 - {DEPTH - 1})) AS i FROM d WHERE len(h) >= {2 * DEPTH})
),
m AS (SELECT k, min(place) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS before FROM w JOIN m USING (k) WHERE place > first),
g AS (
  SELECT rn, i, sum(CASE WHEN before IS NULL OR i > before + {DEPTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i) AS run
  FROM r
),
s AS (SELECT rn, run, min(i) AS a, max(i) + {DEPTH} AS b FROM g GROUP BY ALL),
p AS (SELECT rn, a, b, coalesce(lag(b) OVER (PARTITION BY rn ORDER BY a), 0) AS before FROM s),
k AS (
  SELECT rn, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM p JOIN d USING (rn) GROUP BY rn
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rn)
"""
