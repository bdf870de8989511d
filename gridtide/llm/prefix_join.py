"""Documents alike by the Jaccard similarity of their word shingles, joined by adaptive multi-match prefixes.

All shingles have one order, rare ones first. If two sets of sizes ``n`` and ``m`` have ``need`` shingles in common,
then their first ``n - need + l`` and ``m - need + l`` shingles have ``l`` in common, for any ``l``. A document with
a cheap prefix takes ``l = 1``; one whose prefix holds frequent shingles takes a longer prefix and asks for more matches.
The cost that decides is estimated from a table of shingle counts over all documents. A pair needs the smaller ``l``
of its two documents, which both prefixes cover.

Equal sets are one class. Before all candidates are sought, the members of each shingle's list meet one hub of the list;
what is linked by then needs no further look, so a large group of near copies costs one pair for each member. The
rest is an exact join: lists are split by the size of the smaller set, a document looks only where a partner of that size can
still reach the similarity, and only at members of other components. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import passing, pieces, read_table, settle
from gridtide.llm.components import connected_components

SHINGLE_WORDS = 5
PERCENT = 80
MOST_MATCHES = 8
#: Price of verifying one candidate, in rows of the join.
VERIFY_ROWS = 8.0
HASH_SEED = 42
BUCKET_BITS = 22
BLOCK = 1 << 12
BAND_RATIO = 1.04


def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    width = min(words, len(found))
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    parts = map(b" ".join, zip(*(found[i:] for i in range(width))))
    return np.unique(np.fromiter((digest(s, seed) for s in parts), dtype=np.uint64))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _blocks(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block, part in counts.items():
        packed = zlib.compress(part.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])


def _count(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                np.add.at(counts, _bucket(shingles(text.as_py(), words)), 1)
        blocks = counts.reshape(-1, BLOCK)
        yield from _blocks({int(b): blocks[b] for b in np.flatnonzero(blocks.any(axis=1))})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(packed), dtype=np.int64)
            sums[block] = sums[block] + part if block in sums else part
    yield from _blocks(sums)


def shingle_counts(texts: DataFrame, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, float]:
    """Counts of shingles over all texts in a table of fixed size, by the upper bits of the hash, and their mean.

    Shingles that share a place are counted together, which may lengthen a list but loses no pair.
    """
    parts = texts.select("text").mapInArrow(_count(words), "block int, counts binary")
    merged = parts.repartition(F.col("block")).mapInArrow(_merge, "block int, counts binary").collect()
    table = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for row in merged:
        table[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)
    return np.minimum(table, np.iinfo(np.uint16).max).astype(np.uint16), float(table.mean())


def prefix(hashes: np.ndarray, counts: np.ndarray, mean: float, percent: int = PERCENT) -> tuple[int, int, np.ndarray]:
    """Matches asked for, number of leading shingles that no other document has, and the rest of the prefix in order."""
    n = len(hashes)
    seen = counts[_bucket(hashes)]
    order = np.lexsort((hashes, seen))
    seen = seen[order]
    least = -(-percent * n // 100)
    same_size = -(-2 * percent * n // (100 + percent))
    others = np.maximum(seen - 1.0 - mean - 3 * math.sqrt(mean), 0.0).cumsum()
    asked = np.arange(1, min(MOST_MATCHES, least) + 1)
    met = others[np.minimum(n - same_size + asked, n) - 1]
    matches = int(asked[np.argmin(0.02 * asked + met + VERIFY_ROWS * met / asked)])
    end = min(n, n - least + matches)
    alone = min(int(np.searchsorted(seen, 2)), end)
    return matches, alone, hashes[order[alone:end]]


def _sketch(words: int, percent: int, shared, fingerprint: Callable[[bytes | None], int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mean = shared.value
        for batch in (part for whole in batches for part in pieces(whole, 2)):
            texts = batch.column(2).cast(pa.large_binary())
            nodes, sizes, asked, skipped, tokens = [], [], [], [], []
            for text in texts:
                found = shingles(text.as_py(), words)
                first = prefix(found, counts, mean, percent) if len(found) else (0, 0, found)
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sizes.append(len(found)), asked.append(first[0]), skipped.append(first[1]), tokens.append(first[2].view(np.int64))
            prints = np.array([fingerprint(t.as_py()) if fingerprint else 0 for t in texts], dtype=np.uint64)
            columns = [pa.array(nodes, pa.binary()), *(pa.array(c, pa.int32()) for c in (sizes, asked, skipped))]
            columns += [pa.array(tokens, pa.list_(pa.int64())), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                ["doc_id", "row_key", "node", "n", "matches", "skipped", "tokens", "print"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            texts = batch.column(1).cast(pa.large_binary())
            found = [shingles(t.as_py(), words).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["cid", "shingles"])

    return run


def _reach(percent: int) -> Column:
    """Size of the largest set with which a shingle at this place of the prefix still counts."""
    return F.expr(f"CAST((100L + {percent}) * (n + matches - 1 - place) DIV {percent} - n AS INT)")


def _may_link(percent: int, a: str, b: str) -> Column:
    """Whether two postings of a shingle lie in the prefixes that this pair of sizes needs."""
    total, both = f"{percent}L * ({a}.n + {b}.n)", f"least({a}.matches, {b}.matches)"
    return F.expr(
        f"100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n) "
        f"AND {total} <= (100L + {percent}) * ({a}.n + {both} - 1 - {a}.place) "
        f"AND {total} <= (100L + {percent}) * ({b}.n + {both} - 1 - {b}.place)"
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(u, v)`` whose whole sets are alike enough."""
    left = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("cid").alias("v"), F.col("shingles").alias("b"))
    alike = f"(100L + {percent}) * size(array_intersect(a, b)) >= {percent}L * (size(a) + size(b))"
    return pairs.join(left, "u").join(right, "v").where(F.expr(alike)).select("u", "v")


def hub_pairs(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each class with the hub of each of its lists: the member whose shingle comes earliest for its size."""
    early = F.struct((F.col("place").cast("double") / F.col("n")).alias("early"), "cid", "n", "place", "matches")
    hubs = postings.groupBy("token").agg(F.min(early).alias("hub")).select("token", "hub.*")
    found = postings.alias("p").join(hubs.hint("merge").alias("h"), "token").where("p.cid <> h.cid").where(_may_link(percent, "p", "h"))
    return found.select(F.expr("least(p.cid, h.cid)").alias("u"), F.expr("greatest(p.cid, h.cid)").alias("v")).distinct()


def cross_pairs(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidates between components; ``postings`` has ``root``. Each pair has the matches that it needs."""
    mixed = postings.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    live = settle(postings.join(mixed.select("token").hint("merge"), "token").withColumn("reach", _reach(percent)), "live_postings")

    def band(size: str) -> Column:
        return F.floor(F.log(F.expr(size).cast("double")) / math.log(BAND_RATIO)).cast("int")

    smaller = live.where("reach >= n").withColumn("band", band("n"))
    filled = smaller.groupBy("token").agg(F.collect_set("band").alias("bands"))
    low, high = band(f"greatest(1, ({percent}L * n + 99) DIV 100)"), band("greatest(1, least(n, reach))")
    looking = live.join(filled, "token").withColumn("low", low).withColumn("high", high)
    looking = looking.withColumn("band", F.explode(F.expr("filter(bands, b -> b BETWEEN low AND high)")))
    looking = looking.select("token", "band", "cid", "n", "place", "matches", "reach", "root")
    roots = smaller.groupBy("token", "band", F.col("root").alias("of")).agg(F.min("n").alias("n_least"), F.max("reach").alias("reach_most"))
    aimed = looking.join(roots, ["token", "band"]).where("root <> of AND reach >= n_least AND reach_most >= n")
    there = smaller.select("token", "band", F.col("root").alias("of"), "cid", "n", "place", "matches").alias("s")
    met = aimed.alias("l").join(there, ["token", "band", "of"]).where("(s.n, s.cid) < (l.n, l.cid)").where(_may_link(percent, "l", "s"))
    rows = met.select(
        F.expr("least(l.cid, s.cid)").alias("u"), F.expr("greatest(l.cid, s.cid)").alias("v"), F.expr("least(l.matches, s.matches)").alias("asked")
    )
    return rows.groupBy("u", "v").agg(F.count("*").alias("met"), F.min("asked").alias("asked")).where("met >= asked").select("u", "v")


def class_links(
    classes: DataFrame, texts: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, seeds: DataFrame | None = None
) -> DataFrame:
    """``(node, root)`` of all classes linked to another.

    ``classes`` has ``cid``, ``row_key``, ``n``, ``matches``, ``skipped`` and ``tokens``, ``texts`` has ``row_key`` and ``text``.
    ``seeds`` are further pairs ``(u, v)`` to be judged first.
    """
    spark = classes.sparkSession

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()
        keys = classes.select("cid", "row_key").join(wanted, "cid")
        found = texts.join(keys, "row_key").groupBy("cid").agg(F.first("text").alias("text"))
        return settle(found.mapInArrow(_sets(words), "cid long, shingles array<long>"), "shingle_sets")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        with passing(spark) as keep:
            return keep(verified(pairs, sets_of(pairs), percent), f"{name}_links")

    every = classes.select("cid", "n", "matches", "skipped", F.posexplode("tokens").alias("at", "token"))
    every = every.select("token", "cid", "n", (F.col("at") + F.col("skipped")).alias("place"), "matches")
    shared = every.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    with passing(spark) as keep:
        # a list of shingles has no size that Spark knows, so tables of postings are never broadcast
        postings = settle(every.join(shared.hint("merge"), "token"), "postings")
        hubs = hub_pairs(postings, percent)
        judged = settle(hubs if seeds is None else hubs.union(seeds).distinct(), "hub_pairs")
        first = links_of(judged, "hub")
        members = settle(connected_components(first), "hub_members")
        members = members.withColumnRenamed("node", "cid").hint("merge")
        placed = postings.join(members, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        with passing(spark) as keep_pairs:
            unseen = keep_pairs(cross_pairs(placed, percent).join(judged, ["u", "v"], "left_anti"), "cross_pairs")
        rest = links_of(unseen, "cross")
        return keep(connected_components(first.union(rest)), "class_members")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``row_key`` and ``text``; only rows equal in id and text share a key."""
    parts = (F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.coalesce(F.col(text_column), F.lit("")))
    return docs.select(F.col(id_column).alias("doc_id"), F.md5(F.concat_ws(":", *parts)).alias("row_key"), F.col(text_column).alias("text"))


def jaccard_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    fingerprint: Callable[[bytes | None], int] | None = None,
    seeds: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``, by chains of links of ``percent`` or more.

    ``seeds`` may name pairs ``(u, v)`` of classes ``(cid, print)`` to be judged first, where ``print`` is what
    ``fingerprint`` makes of a text; they change the work and not the result.

    Null and empty texts and those without words have no shingles, link with nothing and are their own component. Rows with
    equal sets are linked, repeated rows each return, and texts of any length are used whole. A null id never is the
    smallest of its component, and a component of null ids alone has a null component id. Other columns of ``docs`` are not
    read. An empty table gives an empty result.
    """
    rows = keyed(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows, words))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, row_key string, node binary, n int, matches int, skipped int, tokens array<long>, print long"
    with passing(docs.sparkSession) as keep:
        sketches = settle(rows.mapInArrow(_sketch(words, percent, shared, fingerprint), schema), "sketches")
        one = F.first(F.struct("row_key", "n", "matches", "skipped", "tokens", "print")).alias("one")
        classes = sketches.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), one).select("node", "least_id", "one.*")
        classes = keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        sizes = keep(sketches.select("doc_id", "node", "n"), "set_sizes")
    named = sizes.where("n > 0")
    first = None if seeds is None else seeds(classes.select("cid", "print"))
    members = class_links(classes, rows.select("row_key", "text"), words, percent, first).withColumnRenamed("node", "cid")
    placed = classes.select("node", "cid", "least_id").join(members, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = placed.join(least, "root").select("node", "component_id")
    alone = sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.join(component, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def op11_prefix_join(spark, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS INTEGER) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""
