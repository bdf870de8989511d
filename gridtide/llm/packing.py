"""Length buckets with the least padding, and batches of a token budget inside each bucket.

Texts are cut into pieces of at most ``max_tokens`` tokens, so the histogram of piece lengths has a bounded
number of bins. Dynamic programming over it finds the bucket lengths that pad least. Batches fill up in the
order of a hash of the id: the hash is split into 65,536 shards, pieces are numbered within bucket and shard,
and sums over the shard counts turn these numbers into places in the bucket. No task sees a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import read_table, settle

MAX_TOKENS = 2048
BUCKETS = 8
BATCH_TOKENS = 65_536
SHARD_DIGITS = 4
TOKEN_PATTERN = r"[^\x20\x09-\x0D]+"


def count_tokens(column: str = "text") -> Column:
    """Number of words of a text; none for a null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def best_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths that minimise padding; ``lengths`` rise. Ties take the shorter boundary."""
    m = len(lengths)
    if not m:
        return []
    cum = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(lengths * counts)))
    # padding[i, j]: pieces of bins i..j-1 padded to the length of bin j-1
    top = np.concatenate(([0], lengths))
    padding = top[None, :] * (cum[None, :] - cum[:, None]) - (tokens[None, :] - tokens[:, None])
    far = np.iinfo(np.int64).max // 4
    padding[np.tril_indices(m + 1)] = far
    cost = np.full(m + 1, far)
    cost[0] = 0
    came = []
    for _ in range(min(buckets, m)):
        total = np.minimum(cost[:, None] + padding, far)
        came.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    chosen, j = [], m
    for back in reversed(came):
        chosen.append(int(lengths[j - 1]))
        j = int(back[j])
    return chosen[::-1]


def pieces(docs: DataFrame, tokens: Column | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens)`` of every document; one piece of no tokens where it has none."""
    counted = docs.select("doc_id", (count_tokens() if tokens is None else tokens).alias("total"))
    number = F.greatest(F.lit(1), F.ceil(F.col("total") / max_tokens)).cast("int")
    cut = counted.select("doc_id", "total", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    first = F.col("piece").cast("long") * max_tokens
    return cut.select(
        "doc_id", "piece", first.alias("first_token"), F.least(F.lit(max_tokens), F.col("total") - first).alias("n_tokens")
    )


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    buckets: int = BUCKETS,
    max_tokens: int = MAX_TOKENS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """Every piece with its bucket, padded length, batch within the bucket and slot within the batch.

    A batch holds as many padded pieces as ``batch_tokens`` allows, one at least. Null and empty texts are one
    piece of no tokens in the first bucket. Ids may repeat or be null: pieces with the same id and number are
    told apart by length alone, so equal rows get neighbouring slots. An empty table gives an empty result.
    """
    items = settle(pieces(docs, tokens, max_tokens), "pieces")
    bins = items.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()  # max_tokens + 1 at most
    bounds = best_lengths(np.array([b.n_tokens for b in bins], dtype=np.int64), np.array([b.n for b in bins], dtype=np.int64), buckets)
    if not bounds:
        bounds = [max_tokens]
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    length = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = items.withColumn("bucket", bucket).withColumn("bucket_tokens", length).withColumn("order", order)
    placed = placed.withColumn("shard", F.substring("order", 1, SHARD_DIGITS))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = offsets.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "shard").orderBy("order", "doc_id", "piece", "n_tokens")
    ranked = placed.withColumn("rank", F.row_number().over(within)).join(offsets, ["bucket", "shard"])
    place = F.col("offset") + F.col("rank") - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("bucket_tokens"))))
    return ranked.select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(place / rows).cast("long").alias("batch"),
        (place % rows).cast("long").alias("slot"),
    )


def op6_length_buckets(spark, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return pack(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    levels = []
    for k in range(1, BUCKETS + 1):
        source = "(SELECT 0 AS j, 0::HUGEINT AS v)" if k == 1 else f"L{k - 1}"
        levels.append(
            f"""L{k} AS MATERIALIZED (
  SELECT b.j, min((a.v // 4096 + b.len * (b.cum - coalesce(i.cum, 0)) - (b.tok - coalesce(i.tok, 0))) * 4096 + a.j) AS v
  FROM bins b JOIN {source} a ON a.j < b.j LEFT JOIN bins i ON i.j = a.j GROUP BY b.j)"""
        )
    final = " ".join(f"WHEN (SELECT max(j) FROM bins) >= {k} THEN {k}" for k in range(BUCKETS, 0, -1))
    backs = []
    for k in range(BUCKETS, 0, -1):
        up = "NULL" if k == BUCKETS else f"(SELECT v % 4096 FROM L{k + 1} WHERE j = (SELECT j FROM B{k + 1}))"
        backs.append(
            f"B{k} AS MATERIALIZED (SELECT CASE WHEN (SELECT k FROM used) = {k} THEN (SELECT max(j) FROM bins) "
            f"WHEN (SELECT k FROM used) > {k} THEN {up} END AS j)"
        )
    union = " UNION ALL ".join(f"SELECT {k} AS k, j FROM B{k} WHERE j IS NOT NULL" for k in range(1, BUCKETS + 1))
    return f"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}')) AS total FROM documents),
p AS (
  SELECT doc_id, piece, piece * {MAX_TOKENS} AS first_token, least({MAX_TOKENS}, total - piece * {MAX_TOKENS}) AS n_tokens
  FROM (SELECT doc_id, total, unnest(range(0, greatest(1, CAST(ceil(total / {MAX_TOKENS}.0) AS BIGINT)))) AS piece FROM d)
),
bins AS MATERIALIZED (
  SELECT n_tokens AS len, row_number() OVER (ORDER BY n_tokens) AS j, sum(n) OVER (ORDER BY n_tokens) AS cum,
    sum(n * n_tokens) OVER (ORDER BY n_tokens) AS tok
  FROM (SELECT n_tokens, count(*) AS n FROM p GROUP BY n_tokens)
),
used AS MATERIALIZED (SELECT CASE {final} ELSE 0 END AS k),
{", ".join(levels)},
{", ".join(backs)},
bounds AS MATERIALIZED (SELECT k - 1 AS bucket, len FROM ({union}) c JOIN bins USING (j)),
q AS (
  SELECT p.*, (SELECT count(*) FROM bounds b WHERE b.len < p.n_tokens) AS bucket,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM p
),
r AS (
  SELECT q.*, len AS bucket_tokens,
    row_number() OVER (PARTITION BY bucket ORDER BY o, doc_id NULLS FIRST, piece, n_tokens) - 1 AS place
  FROM q JOIN bounds USING (bucket)
)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(first_token AS BIGINT) AS first_token,
  CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(bucket_tokens AS BIGINT) AS bucket_tokens,
  CAST(place // greatest(1, {BATCH_TOKENS} // greatest(1, bucket_tokens)) AS BIGINT) AS batch,
  CAST(place % greatest(1, {BATCH_TOKENS} // greatest(1, bucket_tokens)) AS BIGINT) AS slot
FROM r
"""


OP6_SQL = _sql()
