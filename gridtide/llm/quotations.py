"""Conversations in reply order, from messages that quote each other.

Lines are read with their level of quotation (the number of leading ``>``); lines of one level without a blank
between them are a passage. Passages are normalised (case, white space, wrapping) and hashed. A quoted passage
belongs to the latest earlier message of the conversation that has it as its own text, found in the order of
turns within equal hashes, never by pairing all quotes with all originals. A message replies to the original of
its least nested quote. Depth and root come from pointer jumping, so the number of joins follows the logarithm of
the longest chain. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import ASCII_LOWER, ASCII_UPPER, read_table, settle

MARKS = r"^((?:[ \t]*>)*)"
ATTRIBUTION = r"(?i)^\s*on .{1,200} wrote:\s*$"
MESSAGE = ["conv_id", "turn"]


def own_text(text):
    """Text without quoted lines and the line that introduces a quote, trimmed."""
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: ~x.rlike(r"^[ \t]*>") & ~x.rlike(ATTRIBUTION)
    )
    return F.regexp_replace(F.array_join(lines, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, hash)`` of every passage."""
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*MESSAGE, "text").distinct()
    lines = rows.select(*MESSAGE, F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\r?\n")).alias("no", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    content = F.trim(F.regexp_replace(F.substring(F.col("line"), F.length(marks) + 1, F.length("line")), r"[ \t\r]+", " "))
    lines = lines.select(*MESSAGE, "of", "no", F.length(F.translate(marks, " \t", "")).alias("level"), content.alias("content"))
    lines = lines.where(~F.col("content").rlike(ATTRIBUTION))
    along = Window.partitionBy(*MESSAGE, "of").orderBy("no")
    new = (F.col("level") != F.lag("level", 1, -1).over(along)) | (F.col("content") == "")
    runs = lines.withColumn("run", F.sum(new.cast("int")).over(along)).where("content <> ''")
    whole = runs.groupBy(*MESSAGE, "of", "run").agg(
        F.first("level").alias("level"), F.sort_array(F.collect_list(F.struct("no", "content"))).alias("lines")
    )
    text = F.lower(F.array_join(F.transform("lines", lambda x: x["content"]), " "))
    return whole.select(*MESSAGE, "level", F.md5(text.cast("binary")).alias("hash")).distinct()


def quote_links(found: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, n_quoted, n_linked)`` of the messages with quoted passages."""
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("level") == 0
    known = found.withColumn("own", own).withColumn("source", F.last(F.when(own, F.col("turn")), True).over(earlier))
    quoted = known.where("NOT own").groupBy(*MESSAGE)
    best = F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), F.col("source"))))
    return quoted.agg(
        best["source"].alias("reply_to"), F.count("*").alias("n_quoted"), F.count("source").alias("n_linked")
    )


def roots(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, root, depth)`` from ``(conv_id, turn, reply_to)``; a row without ``reply_to`` is a root."""
    done = parents.where("reply_to IS NULL").select(*MESSAGE, F.col("turn").alias("root"), F.lit(0).alias("depth"))
    done = settle(done, "thread_roots")
    left = settle(parents.where("reply_to IS NOT NULL").select(*MESSAGE, F.col("reply_to").alias("up"), F.lit(1).alias("steps")), "threads")
    while left.limit(1).count():
        top = done.select("conv_id", F.col("turn").alias("up"), "root", "depth")
        reached = left.join(top, ["conv_id", "up"]).select(*MESSAGE, "root", (F.col("depth") + F.col("steps")).alias("depth"))
        jump = left.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("to"), F.col("steps").alias("more"))
        onward = left.join(jump, ["conv_id", "up"]).select(*MESSAGE, F.col("to").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        done, left = settle(done.union(reached), "thread_roots"), settle(onward, "threads")
    return done


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, reply_to, root, depth, n_quoted, n_linked`` of every message, without quotes.

    A message that quotes nothing known replies to the turn before it, if that exists. Rows are ordered by
    conversation, root, depth and turn over the partitions. Repeated messages each return and share one place in the
    thread. Null texts are empty; rows without conversation or turn stand alone, as roots of depth zero. An empty
    table gives an empty result.
    """
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*MESSAGE).distinct()
    links = quote_links(passages(messages))
    before = turns.select("conv_id", F.col("turn").alias("last"), (F.col("turn") + 1).alias("turn"))
    linked = turns.join(links, MESSAGE, "left").join(before, MESSAGE, "left")
    linked = settle(
        linked.select(
            *MESSAGE,
            F.coalesce("reply_to", "last").alias("reply_to"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked")),
        ),
        "replies",
    )
    placed = linked.join(roots(linked), MESSAGE)
    rows = messages.select(*MESSAGE, "role", own_text(F.col("text")).alias("text")).join(placed, MESSAGE, "left")
    rows = rows.withColumns(
        {
            "root": F.coalesce("root", "turn"),
            **{c: F.coalesce(c, F.lit(0)) for c in ("depth", "n_quoted", "n_linked")},
        }
    )
    order = ["conv_id", "root", "depth", "turn"]
    columns = [*MESSAGE, "role", "text", "reply_to", "root", "depth", "n_quoted", "n_linked"]
    return rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)


def as_mail(chats: DataFrame) -> DataFrame:
    """Chat turns as mail, which seldom answers the turn before: a message quotes one two or three turns back, by its ids.

    One in five quotes as it stands, one wraps the lines anew, one changes case, one also quotes what the quoted message
    quotes, and one adds words of its own, so that it is no quote of anything. Where there is no such turn nothing is quoted.
    """
    back = F.lit(2) + F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2))
    mode = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(5))
    texts = chats.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(*MESSAGE).agg(F.max("text").alias("text"))
    quoted = texts.select("conv_id", F.col("turn").alias("q1"), F.col("text").alias("t1"), (F.col("turn") - back).alias("q2"))
    deeper = texts.select("conv_id", F.col("turn").alias("q2"), F.col("text").alias("t2"))
    out = chats.withColumns({"q1": F.col("turn") - back, "mode": mode}).join(quoted, ["conv_id", "q1"], "left")
    out = out.join(deeper, ["conv_id", "q2"], "left")

    def lines(text, marks: str):
        return F.concat(F.lit(f"\n\n{marks}"), F.regexp_replace(text, "\r?\n", f"\n{marks}"))

    said = F.col("t1")
    wrapped = F.regexp_replace(said, "[ \t]+", "\n")
    loud = F.translate(said, ASCII_LOWER, ASCII_UPPER)
    plain = F.when(F.col("mode") == 1, wrapped).when(F.col("mode") == 2, loud).when(F.col("mode") == 4, F.concat(said, F.lit(" or so it was"))).otherwise(said)
    nested = F.when(F.col("mode") == 3, F.coalesce(lines(F.col("t2"), "> > "), F.lit(""))).otherwise("")
    quote = F.coalesce(F.concat(lines(plain, "> "), nested), F.lit(""))
    return out.select(*MESSAGE, "role", F.concat(F.coalesce("text", F.lit("")), quote).alias("text"))


def op4_quotation_links(spark, sf_dir: str) -> DataFrame:
    """Threads of all conversations, put into mail form by quoting, since chat turns quote nothing by themselves."""
    found = reply_ordered(as_mail(read_table(spark, sf_dir, "conversations")))
    return found.select(*MESSAGE, "role", "text", "reply_to", "root", "depth", "n_quoted", "n_linked")


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, max(text) AS text, turn - 2 - (conv_id + turn) % 2 AS q1, (conv_id * 7 + turn * 3) % 5 AS mode,
         lower(trim(regexp_replace(max(text), '[ \t\r\n]+', ' ', 'g'))) AS norm
  FROM conversations GROUP BY ALL
),
q AS (
  SELECT t.conv_id, t.turn, t.mode, a.norm || CASE WHEN t.mode = 4 THEN ' or so it was' ELSE '' END AS n1,
         CASE WHEN t.mode = 3 THEN b.norm END AS n2
  FROM t LEFT JOIN t a ON a.conv_id = t.conv_id AND a.turn = t.q1 LEFT JOIN t b ON b.conv_id = t.conv_id AND b.turn = a.q1
),
s AS (
  SELECT q.conv_id, q.turn, count(DISTINCT n1) FILTER (n1 <> '') + count(DISTINCT n2) FILTER (n2 <> '') AS n_quoted,
         max(e.turn) FILTER (e.norm = n1) AS s1, max(e.turn) FILTER (e.norm = n2) AS s2
  FROM q LEFT JOIN t e ON e.conv_id = q.conv_id AND e.turn < q.turn AND e.norm <> '' GROUP BY 1, 2
),
p AS (
  SELECT s.conv_id, s.turn, n_quoted, CASE WHEN s1 IS NULL THEN 0 ELSE 1 END + CASE WHEN s2 IS NULL THEN 0 ELSE 1 END AS n_linked,
         coalesce(s1, s2, b.turn) AS reply_to
  FROM s LEFT JOIN t b ON b.conv_id = s.conv_id AND b.turn = s.turn - 1
),
r AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM p WHERE reply_to IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, r.root, r.depth + 1 FROM p JOIN r ON p.conv_id = r.conv_id AND p.reply_to = r.turn
)
SELECT c.conv_id, c.turn, c.role, regexp_replace(coalesce(c.text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text,
  p.reply_to, coalesce(r.root, c.turn) AS root, coalesce(r.depth, 0) AS depth,
  CAST(coalesce(p.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(p.n_linked, 0) AS BIGINT) AS n_linked
FROM conversations c LEFT JOIN p USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
"""
