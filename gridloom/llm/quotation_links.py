"""Conversations from quoting messages, in DataFrame functions only.

Lines that begin with `>` are quoted, once for each `>`. Adjacent lines of one level form a passage. A
passage and each of its lines are normalised (lower case, blanks collapsed) and hashed with SHA-256, as are
each message's own text (its level 0) and the lines of that; quoted lines of under `LEAST` characters, which many
messages share, count only where they are the whole passage; so trimmed quotes, and quotes cut up by replies
between them, link too. Each quoted hash is joined to the latest earlier message of its thread that has it as its
own. A message replies to what its quotes of the shallowest level with a match point at: the message
with most quoted characters, then the latest. Reply links are followed by pointer doubling, so a chain
of n replies takes log n steps, and give each message its root and depth; the body is its own text
without quotes.

A thread is read in blocks of `BLOCK` turns, each with what the blocks before had last, so a text that
one thread repeats without end is neither joined with itself nor sorted in one task.

Passages without a word match nothing. Null texts have an empty body and no links; null threads link
with nothing and messages there are their own roots. Rows of one (thread, turn) all stay and link alike,
by what any of their texts quotes; each keeps its own body. Extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import staged

BLOCK, LEAST = 4096, 12


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """messages(thread, turn, hash, text) -> thread, turn, hash, level, at (first line), passage (lines joined).

    Lines stay in their own row: a line begins a passage where its level differs from the one before."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, r"^((?:> ?)*+)", 1), " ", "")).alias("level"), F.regexp_replace(x, r"^(?:> ?)*+", "").alias("line"))
    rows = messages.withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line))
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: ~F.get("lines", k - 1)["level"].eqNullSafe(F.get("lines", k)["level"]))
    rows = rows.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("lines")))
    spans = F.arrays_zip(F.col("begins").alias("at"), ends.alias("end"))
    rows = rows.withColumn("span", F.explode(spans))
    part = F.slice("lines", F.col("span.at") + 1, F.col("span.end") - F.col("span.at"))
    return rows.select("thread", "turn", "hash", F.get("lines", F.col("span.at"))["level"].alias("level"), F.col("span.at").alias("at"), F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("passage"))


def _units(rows: DataFrame, text: str, *more: str, least: int = 1) -> DataFrame:
    """thread, turn, more.. of rows with the hash and length of the whole text and of each line of `least` characters, normalised; those without a word left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda u: F.length(u) >= least)
    units = F.filter(F.array_distinct(F.concat(F.array(normalised(F.col(text))), lines)), lambda u: u != "")
    units = rows.select("thread", "turn", *more, F.explode(units).alias("unit"))
    return units.select("thread", "turn", *more, F.sha2("unit", 256).alias("hash"), F.length("unit").alias("size"))


def reply_conversations(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """Per message: thread, turn, role, parent_turn, root_turn, depth, quote_levels, body."""
    rows = messages.select(F.col(thread).alias("thread"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    parts = passages(rows.dropDuplicates(["thread", "turn", "hash"]))
    whole = parts.groupBy("thread", "turn", "hash").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "passage")))), lambda x: x["passage"]), "\n").alias("body"),
        F.max("level").alias("quote_levels"),
    )
    whole = staged(whole, "bodies")
    own = _units(whole, "body").select("thread", "turn", "hash", F.col("turn").alias("origin"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("size"))
    quoted = _units(parts.where("level > 0"), "passage", "level", least=LEAST).select("thread", "turn", "hash", F.lit(None).cast("long").alias("origin"), "level", "size")
    met = own.unionByName(quoted).where("thread IS NOT NULL").withColumn("block", F.floor(F.col("turn") / BLOCK))
    met = staged(met.join(quoted.select("thread", "hash").distinct(), ["thread", "hash"], "left_semi"), "met")
    blocks = met.groupBy("thread", "hash", "block").agg(F.max("origin").alias("last"))
    before = Window.partitionBy("thread", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("thread", "hash", "block", F.max("last").over(before).alias("before"))
    inside = Window.partitionBy("thread", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    told = met.withColumn("inside", F.max("origin").over(inside)).where("level IS NOT NULL").join(blocks, ["thread", "hash", "block"])
    told = told.withColumn("origin", F.coalesce("inside", "before")).where("origin IS NOT NULL")
    votes = told.groupBy("thread", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    parents = votes.groupBy("thread", "turn").agg(F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("origin")).alias("back"))).alias("best"))
    links = parents.select("thread", "turn", (-F.col("best.back")).alias("parent"))
    at = whole.select("thread", "turn").distinct().join(links, ["thread", "turn"], "left")
    at = staged(at.select("thread", "turn", "parent", F.coalesce("parent", "turn").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNotNull().alias("open")), "links")
    while at.where("open").limit(1).count():  # rows that have reached their root are not joined again
        up = at.select("thread", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        further = at.where("open").join(up, ["thread", "root"], "left").select("thread", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce(F.col("next") < F.col("root"), F.lit(False)).alias("open"))
        at = staged(at.where("NOT open").unionByName(further), "links")
    at = at.drop("open")
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    bodies = rows.join(whole, same(rows, whole, "thread", "turn", "hash")).select(rows["thread"], rows["turn"], rows["role"], "body", "quote_levels")
    out = bodies.join(at, same(bodies, at, "thread", "turn"))
    return out.select(
        bodies["thread"].alias(thread), bodies["turn"].alias(turn), bodies["role"].alias(role),
        F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth", F.col("quote_levels").cast("long").alias("quote_levels"), "body",
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """Turns of chats as mail clients would send them: each quotes the turn before it, and that one the turn before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    clean = F.coalesce(F.col("text"), F.lit(""))
    quoted = lambda text, mark: F.when(text.isNotNull(), F.concat(F.lit("\n"), F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))).otherwise(F.lit(""))
    return conversations.withColumn("clean", clean).select("conv_id", "turn", "role", F.concat("clean", quoted(F.lag("clean", 1).over(order), "> "), quoted(F.lag("clean", 2).over(order), "> > ")).alias("text"))
