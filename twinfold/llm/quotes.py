"""Quotation linking in conversations (DataFrame functions only).

A line that begins with ``>`` marks is quoted, as deep as it has marks.  Quoted
passages are the runs of lines of one depth.  Passages and their lines are
normalised (lower case, one space for white space) and hashed, and joined with
the hashes of the unquoted texts and lines of the same conversation; of several
messages with one text the first holds it.  A message replies to the earlier
message that holds most lines of its depth-1 quotations (a whole passage counts
before any lines; ties go to the earlier message).  Threads are resolved by
pointer doubling, and a conversation is put in order by thread and turn.

Holders are counted exactly.  A quoted line meets all its holders only where it
has ``FREQUENT`` at most.  More frequent lines are compared as sets: messages that
hold the same ones are folded to the first of them, so a common line in a
long conversation makes no pairs of messages.  What grows is the number of distinct sets.

Nulls: a null text is empty; a null conversation is one of its own; a message
without turn comes first, neither replies nor is replied to.  Repeated rows of
one turn are the same message.  Messages without linked quotations begin a
thread.  An empty table gives an empty result; columns named like the
results are replaced, others carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.ranking import with_row_index
from twinfold.sources.lineage import stored

_MARKS = r"^(?:[ \t]*>)+"
FREQUENT = 16  # holders of a line in a conversation above which it is compared by sets


def _depth(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(F.regexp_replace(marks, r"[ \t]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def parsed(messages: DataFrame, text_column: str = "text") -> DataFrame:
    """``messages`` with ``__lines array<struct<depth, text, passage>>``; a passage is named by its first line's number."""
    lines = F.transform(F.split(F.coalesce(F.col(text_column), F.lit("")), "\r?\n"),
                        lambda x: F.struct(_depth(x).alias("depth"), F.regexp_replace(x, _MARKS + "[ ]?", "").alias("text")))

    def begins(x: Column, i: Column) -> Column:
        return F.when((i > 0) & (F.get("__raw", i - 1)["depth"] == x["depth"]), F.lit(None).cast("int")).otherwise(i)

    first = F.filter(F.transform("__raw", begins), lambda x: x.isNotNull())
    # runs of one depth: from each first line to the next
    runs = F.transform("__first", lambda a, k: F.slice(
        "__raw", a + 1, F.coalesce(F.get("__first", k + 1), F.size("__raw")) - a))
    return (messages.withColumn("__raw", lines).withColumn("__first", first).withColumn("__runs", runs)
            .drop("__raw", "__first"))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text_column: str = "text") -> DataFrame:
    """``messages`` with ``body`` (the text without quotations) in place of the text, ``n_quotes``, ``n_linked``, ``reply_to``,
    ``thread`` and ``position`` (from 0, in reply order)."""
    key = F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit("null"))
    messages = messages.drop("body", "n_quotes", "n_linked", "reply_to", "thread", "position")
    read = stored(parsed(messages.withColumn("__conv", key), text_column), "messages")
    own = F.flatten(F.filter("__runs", lambda r: r[0]["depth"] == 0))
    body = F.regexp_replace(_joined(own), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    quotes = F.filter("__runs", lambda r: r[0]["depth"] > 0)

    units = F.array_union(F.array(_normal(_joined(own))), F.transform(own, lambda x: _normal(x["text"])))
    held = (read.filter(F.col(turn).isNotNull()).select("__conv", F.col(turn).alias("holder"), F.explode(units).alias("unit")).filter("unit <> ''")
            .select("__conv", F.xxhash64("unit").alias("unit"), F.length("unit").alias("size"), "holder").distinct())
    held = stored(held, "held")
    first = held.groupBy("__conv", "unit", "size").agg(F.min("holder").alias("holder"))
    each = read.filter(F.col(turn).isNotNull()).select("__conv", turn, F.posexplode(quotes).alias("passage", "lines"))
    each = each.select("__conv", turn, "passage", F.element_at("lines", 1)["depth"].alias("depth"),
                       F.array_union(F.array(_normal(_joined(F.col("lines")))), F.transform("lines", lambda x: _normal(x["text"]))).alias("units"))
    asked = (each.select("__conv", turn, "passage", "depth", F.posexplode("units").alias("at", "unit")).filter("unit <> ''")
             .select("__conv", turn, "passage", "depth", (F.col("at") == 0).cast("int").alias("whole"), F.xxhash64("unit").alias("unit"), F.length("unit").alias("size")))
    asked = stored(asked, "quotations")
    met = asked.join(stored(first, "first-holders"), ["__conv", "unit", "size"]).filter(F.col("holder") < F.col(turn))
    best = _most_lines(asked.filter("depth = 1").withColumnRenamed(turn, "turn"), held).withColumnRenamed("turn", turn)
    linked = met.groupBy("__conv", turn).agg(F.countDistinct("passage").alias("n_linked"))
    replies = stored(linked.join(best, ["__conv", turn], "left"), "replies")
    roots = _roots(replies.filter("reply_to is not null").select("__conv", F.col(turn).alias("turn"), F.col("reply_to").alias("thread")))

    out = (read.join(replies, ["__conv", turn], "left")
           .join(roots.withColumnRenamed("turn", turn), ["__conv", turn], "left")
           .withColumn("thread", F.coalesce("thread", F.col(turn))).withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
           .withColumn("n_quotes", F.size(quotes).cast("bigint")).withColumn("body", body).drop("__runs", text_column))
    out = with_row_index(out, ["__conv", F.col("thread").asc_nulls_first(), F.col(turn).asc_nulls_first()])
    begin = stored(out.groupBy("__conv").agg(F.min("__index").alias("__begin")), "begins")
    return out.join(begin, "__conv").withColumn("position", F.col("__index") - F.col("__begin")).drop("__conv", "__index", "__begin")


def _most_lines(asked: DataFrame, held: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``__conv, turn, reply_to``: the earlier holder of a whole passage and then of most quoted lines, the first of equals."""
    key = ["__conv", "unit", "size"]
    asked = stored(asked.groupBy("turn", *key).agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n")), "asked")
    # only what somebody quotes counts
    sizes = held.join(asked.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("holders"))
    often = stored(sizes.withColumn("often", F.col("holders") > frequent).drop("holders"), "frequent")
    held, asked = stored(held.join(often, key), "holders"), stored(asked.join(often, key), "asked-often")
    asks = stored(asked.filter("often").groupBy("__conv", "turn").agg(
        F.sort_array(F.collect_list(F.struct("unit", "size", "whole", "n"))).alias("asks")), "asked-sets")
    has = stored(held.filter("often").groupBy("__conv", "holder").agg(
        F.sort_array(F.collect_list(F.struct("unit", "size"))).alias("has")), "held-sets")

    few = (asked.filter("not often").join(held.filter("not often").drop("often"), key).filter(F.col("holder") < F.col("turn"))
           .groupBy("__conv", "turn", "holder").agg(F.max("whole").alias("whole"), F.sum("n").alias("n")))
    both = F.filter("asks", lambda x: F.array_contains("has", F.struct(x["unit"], x["size"])))
    both = F.coalesce(both, F.expr("array()").cast(asks.schema["asks"].dataType))
    few = (few.join(asks, ["__conv", "turn"], "left").join(has, ["__conv", "holder"], "left").withColumn("both", both)
           .select("__conv", "turn", "holder", F.greatest("whole", F.array_max(F.transform("both", lambda x: x["whole"]))).alias("whole"),
                   (F.col("n") + F.aggregate("both", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])).alias("n")))

    sets = has.groupBy("__conv", "has").agg(F.min("holder").alias("holder")).select("__conv", "holder", F.inline("has"))
    wanted = asks.select("__conv", "asks").distinct().select("__conv", "asks", F.inline("asks"))
    many = (wanted.join(stored(sets, "sets"), key).groupBy("__conv", "asks", "holder").agg(F.max("whole").alias("whole"), F.sum("n").alias("n"))
            .groupBy("__conv", "asks", "whole", "n").agg(F.min("holder").alias("holder")))
    many = asks.join(stored(many, "frequent-lines"), ["__conv", "asks"]).filter(F.col("holder") < F.col("turn")).select(few.columns)
    return (few.unionByName(many).groupBy("__conv", "turn").agg(F.max(F.struct("whole", "n", (-F.col("holder")).alias("back"))).alias("best"))
            .select("__conv", "turn", (-F.col("best.back")).alias("reply_to")))


def _roots(links: DataFrame) -> DataFrame:
    """``__conv, turn, thread``: the message that each chain of replies leads to."""
    links = stored(links, "threads")
    while True:
        above = links.select("__conv", F.col("turn").alias("thread"), F.col("thread").alias("higher"))
        moved = stored(links.join(above, ["__conv", "thread"], "left"), "threads")
        if moved.filter("higher is not null").isEmpty():
            return links
        links = moved.select("__conv", "turn", F.coalesce("higher", "thread").alias("thread"))
