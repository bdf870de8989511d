"""Benchmark decontamination: windows of benchmark words sought in the documents.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A window is ten
consecutive words of an item, or all its words if it has fewer. The windows travel to the tasks as a hash
set while the benchmark has at most ``broadcast_words`` words, and each document is scanned where it is
read, without a shuffle. Beyond that bound the windows of documents that share a 20-bit hash prefix with
some benchmark window are joined with the benchmark in a shuffle. Either way words are compared in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.common import ASCII_LOWER, ASCII_UPPER, read_table, slices

WINDOW_WORDS = 10
BROADCAST_WORDS = 200_000
PREFIX_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xBF58476D1CE4E5B9)
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("rest", T.StringType()),
    ]
)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased byte and whether it belongs to a word, per byte."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


LOWER, IS_WORD = _byte_classes()


class Words:
    """Words of several texts laid end to end."""

    def __init__(self, texts: list[bytes | None]) -> None:
        joined = b"\n".join(t or b"" for t in texts)
        self.bytes = LOWER[np.frombuffer(joined, dtype=np.uint8)]
        inside = IS_WORD[self.bytes]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        self.text_start = np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))
        self.first = np.searchsorted(self.start, self.text_start)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        letters = self.bytes[inside].astype(np.uint64) + np.uint64(1)
        length = self.end - self.start
        at = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.arange(len(letters)) - np.repeat(at, length)
        powers = np.cumprod(np.full(int(length.max()), MULTIPLIER)) if len(letters) else np.empty(0)
        sums = np.add.reduceat(letters * powers[within], at)
        return (sums ^ (sums >> np.uint64(29))) * MIXER

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window that starts at each word, for the first words that can start one."""
        n = max(0, len(self.hashes) - width + 1)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            out = out * MULTIPLIER + self.hashes[k : k + n]
        return (out ^ (out >> np.uint64(32))) * MIXER

    def window(self, at: int, width: int) -> bytes:
        start, end = self.start, self.end
        return b" ".join(self.bytes[start[i] : end[i]].tobytes() for i in range(at, at + width))


def item_windows(text: bytes | None) -> list[tuple[int, int, bytes]]:
    """``(width, hash, words)`` of each window of one benchmark item."""
    words = Words([text])
    n = len(words.hashes)
    if not n:
        return []
    width = min(WINDOW_WORDS, n)
    return [(width, int(h), words.window(i, width)) for i, h in enumerate(words.windows(width))]


class Lookup:
    """Benchmark windows by hash, with a bit table that turns most words away."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]) -> None:
        self.items_of: dict[bytes, set] = {}
        hashes: dict[int, set] = {}
        for item, text in items:
            for width, value, words in item_windows(text):
                self.items_of.setdefault(words, set()).add(item)
                hashes.setdefault(width, set()).add(value)
        self.hashes = {w: np.sort(np.fromiter(v, dtype=np.uint64, count=len(v))) for w, v in hashes.items()}
        bits = max(16, (64 * max(map(len, self.hashes.values()), default=1)).bit_length())
        self.shift, self.tables = np.uint64(64 - bits), {}
        for width, values in self.hashes.items():
            self.tables[width] = np.zeros(1 << bits, dtype=bool)
            self.tables[width][values >> self.shift] = True

    def hits(self, words: Words) -> list[tuple[int, int, set]]:
        """``(first word, width, items)`` of every benchmark window found, words compared."""
        found = []
        for width, known in self.hashes.items():
            values = words.windows(width)
            maybe = np.flatnonzero(self.tables[width][values >> self.shift])
            place = np.searchsorted(known, values[maybe])
            maybe = maybe[known[np.minimum(place, len(known) - 1)] == values[maybe]]
            for at in maybe[words.text_of[maybe] == words.text_of[maybe + width - 1]]:
                if items := self.items_of.get(words.window(at, width)):
                    found.append((int(at), width, items))
        return found


def _spans(words: Words, hit: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Byte ranges of runs of hit words in text ``k``."""
    a, b = words.first[k], words.first[k + 1]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
    base = words.text_start[k]
    return [(int(words.start[a + x] - base), int(words.end[a + y - 1] - base)) for x, y in zip(edges[::2], edges[1::2])]


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]]).decode("utf-8", "replace")


def _scan(items: list[tuple[str | None, bytes | None]], want_rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(items)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            rows = []
            for low, high in slices(texts):
                words = Words(texts[low:high])
                hit = np.zeros(len(words.hashes) + 1, dtype=bool)
                of: dict[int, set] = {}
                for at, width, found in lookup.hits(words):
                    hit[at : at + width] = True
                    of.setdefault(int(words.text_of[at]), set()).update(found)
                counts = np.diff(words.first)
                for k in range(high - low):
                    spans = _spans(words, hit, k) if k in of else []
                    rest = None
                    if want_rest and texts[low + k] is not None:
                        rest = _without(texts[low + k], spans)
                    n_hit = int(hit[words.first[k] : words.first[k + 1]].sum()) if spans else 0
                    ids = sorted(x for x in of.get(k, ()) if x is not None)
                    rows.append((int(counts[k]), n_hit, ids, [list(s) for s in spans], rest))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds))], ["row", *HITS.names]
            )

    return run


def _window_rows(prefixes: dict[int, np.ndarray] | None):
    """Windows of texts as rows; of documents only those with a hash prefix that the benchmark has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for low, high in slices(texts):
                owner, at_word, wide, prefix, content = [], [], [], [], []
                if prefixes is None:
                    for k in range(low, high):
                        for at, (width, value, words) in enumerate(item_windows(texts[k])):
                            owner.append(k), at_word.append(at), wide.append(width), content.append(words)
                            prefix.append(value >> (64 - PREFIX_BITS))
                else:
                    words = Words(texts[low:high])
                    for width, table in prefixes.items():
                        heads = words.windows(width) >> np.uint64(64 - PREFIX_BITS)
                        starts = np.flatnonzero(table[heads])
                        for at in starts[words.text_of[starts] == words.text_of[starts + width - 1]]:
                            k = int(words.text_of[at])
                            owner.append(low + k), at_word.append(int(at - words.first[k])), wide.append(width)
                            content.append(words.window(at, width)), prefix.append(int(heads[at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(at_word, pa.int64()),
                        pa.array(wide, pa.int64()),
                        pa.array(prefix, pa.int64()),
                        pa.array(content, pa.binary()),
                    ],
                    ["row", "at", "width", "prefix", "words"],
                )

    return run


def _marked(want_rest: bool):
    """Rows with their number of words, and spans and rest for sorted numbers of hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            marks = batch.column(2)
            counts, spans, rests = [], [], []
            for low, high in slices(texts):
                words = Words(texts[low:high])
                counts.extend(np.diff(words.first).tolist())
                hit = np.zeros(len(words.hashes) + 1, dtype=bool)
                for k in range(high - low):
                    if marks[low + k].is_valid:
                        hit[words.first[k] + marks[low + k].values.to_numpy()] = True
                for k in range(high - low):
                    found = _spans(words, hit, k) if marks[low + k].is_valid else []
                    spans.append([list(x) for x in found])
                    text = texts[low + k]
                    rests.append(_without(text, found) if want_rest and text is not None else None)
            kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
            columns = (pa.array(c, type=k) for c, k in zip((counts, spans, rests), kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "n_words", "spans", "rest"])

    return run


def find_windows(
    docs: DataFrame, items: DataFrame, want_rest: bool = False, broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """``row`` (all columns of a document), ``n_words``, ``n_hit``, ``items``, ``spans`` and ``rest``.

    ``items`` are the sorted ids, as strings, of benchmark items with a window in the text; ``spans`` the byte
    ranges of runs of hit words; ``rest`` the text without them where ``want_rest``. Null and empty texts have no
    words. An item with a null id marks words but is not counted; items without words and an empty benchmark mark
    nothing. Repeated rows each return. ``docs`` needs no column but ``text``. Beyond ``broadcast_words`` words rows equal
    in all columns are sought as one and returned as often.
    """
    tests = items.select(F.col("item_id").cast("string"), "text")
    source = docs.select(F.struct("*").alias("row"), "text")
    row_type = T.StructField("row", source.schema["row"].dataType)
    size = tests.select(F.sum(F.length("text")).alias("n")).first().n or 0
    if size <= 2 * broadcast_words:
        rows = [(r.item_id, None if r.text is None else r.text.encode()) for r in tests.collect()]
        return source.mapInArrow(_scan(rows, want_rest), T.StructType([row_type, *HITS.fields]))
    text = T.StructType(
        [T.StructField("at", T.LongType()), T.StructField("width", T.LongType()), T.StructField("prefix", T.LongType()),
         T.StructField("words", T.BinaryType())]
    )
    bench = tests.select("item_id", "text").mapInArrow(
        _window_rows(None), T.StructType([T.StructField("row", T.StringType()), *text.fields])
    )
    bench = bench.select(F.col("row").alias("item_id"), "width", "prefix", "words").distinct()
    tables: dict[int, np.ndarray] = {}
    for found in bench.select("width", "prefix").distinct().toLocalIterator():
        tables.setdefault(found.width, np.zeros(1 << PREFIX_BITS, dtype=bool))[found.prefix] = True
    key = F.md5(F.to_json(F.struct("*")))  # of whole rows, whichever columns they have
    keyed = docs.select(key.alias("row"), "text")
    seen = keyed.distinct().mapInArrow(_window_rows(tables), T.StructType([keyed.schema["row"], *text.fields]))
    marks = seen.join(bench, ["width", "prefix", "words"])
    hit = marks.select("row", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("w")).distinct()
    hits = hit.groupBy("row").agg(F.collect_list("w").alias("hit"))
    ids = marks.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = hits.join(ids.withColumnRenamed("row", "k"), F.col("row").eqNullSafe(F.col("k"))).drop("k")
    whole = docs.select(F.struct("*").alias("row"), key.alias("k"), "text")
    joined = whole.join(found.withColumnRenamed("row", "k1"), F.col("k").eqNullSafe(F.col("k1")), "left")
    given = joined.select(F.struct("row", "items", F.size("hit").alias("n")).alias("row"), "text", "hit")
    outer = T.StructType([given.schema["row"], *(HITS[c] for c in ("n_words", "spans", "rest"))])
    return given.mapInArrow(_marked(want_rest), outer).select(
        "row.row",
        "n_words",
        F.greatest("row.n", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("row.items", F.array().cast("array<string>")).alias("items"),
        "spans",
        "rest",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return find_windows(docs, items).where("n_hit = 0").select("row.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = find_windows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORD_LIST = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORD_LIST} AS w FROM documents),
b AS (SELECT item_id, {WORD_LIST} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT item_id, w, least({WINDOW_WORDS}, len(w)) AS k FROM b WHERE len(w) > 0))
),
dw AS (
  SELECT rn, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
),
hits AS (SELECT rn, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.words = bw.words),
n AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rn),
ids AS (
  SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rn) LEFT JOIN ids USING (rn)
"""
