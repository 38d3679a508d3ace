"""Quotation linking: replies found by what messages quote; DataFrame functions only.

A line that begins with '>' marks is quoted, at the level of their number.  Runs of quoted lines
of one level are passages (a blank one ends a run); passages and their lines are normalised
(lower case, white space runs as one space) and hashed, and joined to the earliest message of the
conversation that says the same in its own words, as a paragraph, a line or as a whole.  A message replies to
the message that holds most of what it quotes at its lowest matched level.  Threads follow replies to
their first message; a conversation is ordered by thread and then by turn, so every message comes
after the one it answers, and its quotes (with the line that introduces them) are taken out.

Defined results: a null or empty text quotes nothing and stays empty; rows that repeat a turn are
messages of their own that share links; messages with a null turn neither quote nor
are quoted and come last; null conversation ids form one conversation; quotes of unknown or later text
link nowhere but are still taken out; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spread import lookup, numbered
from riskloom.runtime import pin

QUOTED = r"(?m)^[\x20\t]*>"
MARKS = r"^((?:[\x20\t]*>)+)"
INTRODUCTION = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def normal(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Level and body of every line."""
    return F.transform(F.split(text, "\r?\n", -1), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[\x20\t]", "")).alias("level"),
        F.regexp_replace(line, MARKS, "").alias("body"),
    ))


def _own_text(lines: Column) -> Column:
    """Lines of level 0 without those that introduce a quote, blank ends cut."""
    own = F.filter(
        F.transform(lines, lambda line, i: F.struct(
            line["level"].alias("level"), line["body"].alias("body"),
            (line["body"].rlike(INTRODUCTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)).alias("leads"),
        )),
        lambda line: (line["level"] == 0) & ~line["leads"],
    )
    joined = F.array_join(F.transform(own, lambda line: line["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _passages(lines: Column) -> Column:
    """(level, text) of runs of quoted lines of one level, and of each such line."""
    kind = "array<struct<level:int,text:string>>"
    start = F.struct(F.lit(0).alias("level"), F.array().cast(kind).alias("runs"))

    def add(done: Column, line: Column) -> Column:
        blank = (line["level"] == 0) | (F.trim(line["body"]) == "")
        goes_on = (line["level"] == done["level"]) & ~blank & (F.size(done["runs"]) > 0)
        last = F.element_at(done["runs"], -1)
        longer = F.concat(F.slice(done["runs"], 1, F.size(done["runs"]) - 1), F.array(F.struct(
            last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), line["body"]).alias("text")
        )))
        new = F.concat(done["runs"], F.array(F.struct(line["level"].alias("level"), line["body"].alias("text"))))
        return F.struct(
            F.when(blank, 0).otherwise(line["level"]).alias("level"),
            F.when(blank, done["runs"]).when(goes_on, longer).otherwise(new).alias("runs"),
        )

    runs = F.aggregate(lines, start, add, lambda done: done["runs"])
    single = F.transform(F.filter(lines, lambda line: line["level"] > 0), lambda line: F.struct(
        line["level"].alias("level"), line["body"].alias("text")
    ))
    whole = F.transform(F.concat(runs, single), lambda p: F.struct(p["level"].alias("level"), normal(p["text"]).alias("text")))
    return F.array_distinct(F.filter(whole, lambda p: p["text"] != ""))


def _sayings(own: Column) -> Column:
    """What a message says: all of it, its paragraphs and its lines, normalised."""
    parts = F.concat(F.array(own), F.split(own, r"\n\s*\n", -1), F.split(own, "\n", -1))
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda t: t != ""))


def reply_links(messages: DataFrame) -> DataFrame:
    """Replies (conv, turn, reply_to) and how many passages are linked, of messages (conv, turn, own, passages)."""
    known = messages.filter("turn IS NOT NULL")
    quotes = pin(known.filter(F.size("passages") > 0).select("conv", "turn", F.explode("passages").alias("p")).select(
        "conv", "turn", F.col("p.level").alias("level"), F.xxhash64("p.text").alias("hash"), F.col("p.text").alias("said")
    ).distinct())
    keys = pin(quotes.groupBy("conv", "hash").agg(F.count(F.lit(1)).alias("n")))
    sayings = known.join(keys.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", F.explode(_sayings(F.col("own"))).alias("words"))
    origins = sayings.groupBy("conv", F.xxhash64("words").alias("hash"), "words").agg(F.min("turn").alias("origin"))
    # one row per key: texts that share a hash stay apart in a map
    per_key = origins.groupBy("conv", "hash").agg(F.map_from_entries(F.collect_list(F.struct("words", "origin"))).alias("origins"))
    joined = lookup(quotes, pin(keys.join(per_key, ["conv", "hash"])), ["conv", "hash"], "n").withColumn("origin", F.col("origins")[F.col("said")])
    found = joined.filter(F.col("origin") < F.col("turn"))
    votes = found.groupBy("conv", "turn", "level", "origin").agg(F.sum(F.length("said")).alias("weight"), F.count(F.lit(1)).alias("passages"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "weight", "origin"))["origin"]
    return votes.groupBy("conv", "turn").agg(best.alias("reply_to"), F.sum("passages").alias("n_linked"))


def thread_roots(replies: DataFrame) -> DataFrame:
    """First message of the thread and number of replies up to it, for each reply (conv, turn, reply_to).

    Every round doubles the way looked up, so the rounds grow with the logarithm of the longest chain.
    """
    ways = pin(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        on = ways.select("conv", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        doubled = pin(ways.join(on, ["conv", "root"], "left"))
        ways = doubled.select(
            "conv", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        if doubled.filter("further IS NOT NULL").limit(1).count() == 0:
            return ways


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Messages without quotes, with the message they answer, their thread and their position in the conversation."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text.rlike(QUOTED), _lines(text))
    parsed = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"), "role", text.alias("text"), lines.alias("lines"),
    ).withColumns({
        "own": F.when(F.col("lines").isNotNull(), _own_text(F.col("lines"))).otherwise(F.col("text")),
        "passages": F.when(F.col("lines").isNotNull(), _passages(F.col("lines"))).otherwise(
            F.array().cast("array<struct<level:int,text:string>>")
        ),
        "n_quotes": F.coalesce(F.size(F.filter("lines", lambda line: line["level"] > 0)), F.lit(0)).cast("bigint"),
    }).drop("text", "lines")
    messages = pin(parsed)
    replies = pin(reply_links(messages))
    roots = thread_roots(replies).select(F.col("conv"), "turn", F.col("root").alias("thread"), "depth")
    linked = messages.drop("passages").join(replies.join(roots, ["conv", "turn"]), ["conv", "turn"], "left").withColumns({
        "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("bigint")),
        "n_linked": F.coalesce("n_linked", F.lit(0).cast("bigint")),
    })
    order = [F.col("conv"), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.md5("own")]
    placed = pin(numbered(linked, order, "place"))
    firsts = pin(placed.groupBy("conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    return lookup(placed, firsts, ["conv"], "n").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "n_quotes", "n_linked", "reply_to", "thread", "depth",
        (F.col("place") - F.col("first")).alias("position"),
    )
