"""Quotation linking, by DataFrame functions only.

Messages quote earlier ones with lines that start with '>', nested as deep as there are marks. Quoted passages are hashed after
normalisation and joined to the messages that hold them as their own text; that gives replies, threads, and an order in which each
message follows the one it answers. The messages' own text stays, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.common import Scratch

MARKS = r"^(?:[ \t]*>)+[ \t]?"
ATTRIBUTION = r"(?i)^[ \t]*(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)[^:]*:[ \t\r]*$"
#: Between paragraphs: a line without text.
GAP = r"\n(?:[ \t\r]*\n)+"


def _paragraphs(text: Column) -> Column:
    """Hashes of the normalised paragraphs: lower case, white space as one space, none that is empty."""
    plain = F.transform(F.split(text, GAP, -1), lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s+", " "))))
    return F.transform(F.filter(plain, lambda p: p != ""), lambda p: F.md5(p))


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with key, body (own text), levels (of each line) and lines.

    A line's level is its number of leading '>' marks, with spaces or tabs between. The body is the lines of level 0 in order,
    without lines that introduce a quote ("On ... wrote:") and stand just before one; runs of lines without text become one,
    and outer ones go. A null text gives a null body.
    """
    text = F.col("text").cast("string")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))
    rows = rows.withColumn("lines", F.split("text", r"\r?\n", -1))
    level = F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")))
    rows = rows.withColumn("levels", F.when(F.col("text").rlike(r"(?:^|\n)[ \t]*>"), level))
    introduces = lambda x, i: x.rlike(ATTRIBUTION) & (F.coalesce(F.get("levels", i + 1), F.lit(0)) > 0)
    own = F.array_join(F.transform("lines", lambda x, i: F.when((F.get("levels", i) > 0) | introduces(x, i), F.lit("")).otherwise(x)), "\n")
    own = F.when(F.col("levels").isNull(), F.array_join("lines", "\n")).otherwise(own)
    body = F.regexp_replace(F.regexp_replace(own, GAP, "\n\n"), r"^\s+|\s+$", "")
    return rows.withColumn("body", body).withColumn("key", F.struct("conv_id", "turn", F.xxhash64("text").alias("hash")))


def quoted(rows: DataFrame) -> DataFrame:
    """(key, level, place, passage): the passages that each message quotes, by level, in the order of the text."""
    some = rows.where("levels is not null").select("key", "lines", "levels").dropDuplicates(["key"])
    by_level = some.select("key", "lines", "levels", F.explode(F.array_distinct(F.filter("levels", lambda n: n > 0))).alias("level"))
    text = F.array_join(F.transform("lines", lambda x, i: F.when(F.get("levels", i) == F.col("level"), F.regexp_replace(x, MARKS, "")).otherwise(F.lit(""))), "\n")
    return by_level.select("key", "level", F.posexplode(_paragraphs(text)).alias("place", "passage"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, origin_conv, origin_turn, reply_to, thread_turn, depth, position) for every message.

    A quoted passage comes from the first message of the same conversation that holds it as a paragraph of its own, if that is
    earlier; else from the first message (by conv_id, turn) of another conversation that does; else from none. origin is that of
    the message's first passage that has one, by level and then by place. reply_to is the turn of the first such passage from the
    same conversation. A message without one starts a thread; thread_turn is the turn of a thread's start and depth the number of
    replies from it. position numbers the messages of a conversation from 1: threads by their start, and in a thread by depth and
    turn, so that each follows what it answers. Repeated rows are linked alike; ties of position go to the smaller hash of the
    text. Rows with a null conv_id or turn are linked to none; a null conv_id is one conversation for position. Null texts have a
    null body and no quotes. An empty table gives no rows. Other columns are not read.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "quotes")
    rows = parsed(messages)
    passages = scratch.keep(quoted(rows), "passages")
    asked = passages.select("passage").distinct()
    held = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(_paragraphs(F.col("body"))).alias("passage")).join(asked, "passage", "left_semi")
    per_conv = held.groupBy("passage", "conv_id").agg(F.min("turn").alias("turn"))
    place = F.struct("conv_id", "turn")
    # the first conversation that holds a passage, and the first other one
    first = per_conv.groupBy("passage").agg(F.min(place).alias("first"))
    second = per_conv.join(first, "passage").where(F.col("conv_id") != F.col("first.conv_id")).groupBy("passage").agg(F.min(place).alias("second"))
    found = passages.where("key.conv_id is not null and key.turn is not null").withColumn("conv_id", F.col("key.conv_id"))
    found = found.join(per_conv.withColumnRenamed("turn", "own"), ["passage", "conv_id"], "left").join(first, "passage", "left").join(second, "passage", "left")
    earlier = F.col("own") < F.col("key.turn")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    origin = F.when(earlier, F.struct(F.col("conv_id"), F.col("own").alias("turn"))).otherwise(other)
    rank = F.struct("level", "place")
    links = found.select("key", "level", "place", origin.alias("origin"), F.when(earlier, F.col("own")).alias("own"))
    links = links.groupBy("key").agg(F.count("*").alias("n"), F.min_by("origin", F.when(F.col("origin").isNotNull(), rank)).alias("origin"), F.min_by("own", F.when(F.col("own").isNotNull(), rank)).alias("reply_to"))
    counts = passages.groupBy("key").agg(F.count("*").alias("n_quotes"))
    links = scratch.keep(counts.join(links.select("key", "origin", "reply_to"), "key", "left"), "links")
    threads = _threads(spark, links, scratch)
    out = rows.join(links, "key", "left").join(threads, "key", "left")
    out = out.select(
        "conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.col("origin.conv_id").alias("origin_conv"), F.col("origin.turn").alias("origin_turn"),
        "reply_to", F.coalesce("start", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("key.hash").alias("hash"),
    )
    return _positions(out, scratch).drop("hash")


def _threads(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, start, depth) of messages with a reply_to, by pointer doubling over (conv_id, turn)."""
    replies = links.where("reply_to is not null").select("key", "key.conv_id", "key.turn", F.col("reply_to").alias("start"), F.lit(1).cast("long").alias("depth"))
    now = scratch.keep(replies, "threads")
    while True:
        # of messages with one (conv_id, turn), the first by hash leads on
        up = now.groupBy("conv_id", F.col("turn").alias("start")).agg(F.min_by(F.struct(F.col("start").alias("s"), F.col("depth").alias("d")), "key.hash").alias("up"))
        new = scratch.keep(now.join(up, ["conv_id", "start"], "left").select("key", "conv_id", "turn", F.coalesce("up.s", "start").alias("start"), (F.col("depth") + F.coalesce("up.d", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "threads")
        scratch.drop(now)
        now = new.drop("moved")
        now._scratch_path = new._scratch_path
        if not new.where("moved").limit(1).count():
            return now.select("key", "start", "depth")


def _positions(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Number each conversation's rows without bringing a conversation into one task: ranges are sorted, and counts add up over them."""
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "thread_turn", "depth", "turn", "hash")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    put = scratch.keep(ranged.withColumn("n", F.monotonically_increasing_id()).withColumn("part", F.shiftright("n", 33)), "ordered")
    parts = put.groupBy("conv_id", "part").agg(F.min("n").alias("low"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "low", F.coalesce(before, F.lit(0)).alias("before"))
    joined = put.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.withColumn("position", (F.col("n") - F.col("low") + F.col("before") + 1).cast("long")).drop("n", "part", "c", "p", "low", "before")
