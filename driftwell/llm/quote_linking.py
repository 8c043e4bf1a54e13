"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotations, as deep as there are marks.  Neighbouring lines of one depth are a
passage.  Passages, their paragraphs, lines and sentences are normalised and hashed, and met with those that earlier
messages of the conversation say unquoted, so that a quotation is found that a mail program has wrapped anew, and one that
is part of a paragraph.  What has one or two words is met with whole messages only.  A message answers the one it quotes
most of, at the least depth.  Following the answers up gives each message its thread, and (thread_turn, turn) orders a
conversation so that replies follow what they answer.  Messages leave without quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.llm.scratch import Scratch

MARKS = r"^(?:[\x20\t]*>)+"
#: The line that mail programs put before a quotation.
ATTRIBUTION = r"(?i)\bwrote:[\x20\t]*$"
#: Words that a part of a message must have to be linked.
LEAST_WORDS = 3
#: What parts are put together with while they are sought; a text's own is read as a blank.
_CUT = "\u0001"
#: Turns that are looked through at once; a longer conversation is several ranges.
RANGE = 4096


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\t\n\x0B-\x0D]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, ``lines`` (array of depth and text without marks) and ``body``, the text without quotations.

    A message without quotations is left as it is; what is left of others loses blanks at both ends.
    """
    depth = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(depth(x).alias("depth"), F.regexp_replace(x, MARKS, "").alias("text")))
    out = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), lines.alias("lines"))
    kept = F.filter("lines", lambda x, i: (x["depth"] == 0) & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get("lines", i + 1)["depth"], F.lit(0)) > 0)))
    body = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")
    quotes = F.exists("lines", lambda x: x["depth"] > 0)
    return out.select("conv_id", "turn", "role", "lines", quotes.alias("quotes"), F.when(quotes, body).otherwise(F.col("text")).alias("body"))


def _words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def _parts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, key, words, whole): every part of a message that can be linked, once a message.

    The lines are put together again with a cut wherever the depth changes, and split there.
    """
    fresh = lambda x, i: F.when(x["depth"] == F.get("lines", i - 1)["depth"], F.lit("")).otherwise(F.concat(F.lit(_CUT), x["depth"].cast("string"), F.lit("|")))
    marked = F.array_join(F.transform("lines", lambda x, i: F.concat(fresh(x, i), F.translate(x["text"], _CUT, " "))), "\n")
    passages = F.transform(F.slice(F.split(marked, _CUT), F.lit(2), F.size("lines")), lambda b: F.struct(F.substring_index(b, "|", 1).cast("int").alias("depth"), F.substring(b, F.instr(b, "|") + 1, F.length(b)).alias("text")))
    each = rows.select("conv_id", "turn", F.explode(passages).alias("p")).select("conv_id", "turn", "p.depth", "p.text")
    sentences = F.flatten(F.transform(F.split("text", r"\n\s*\n"), lambda t: F.split(_normal(t), r"(?<=[.!?]) ")))
    named = lambda c, whole: F.transform(c, lambda t: F.struct(_normal(t).alias("text"), F.lit(whole).alias("whole")))
    parts = F.concat(named(F.array("text"), True), named(F.split("text", r"\n\s*\n"), False), named(F.split("text", "\n"), False), named(sentences, False))
    each = each.select("conv_id", "turn", "depth", F.explode(parts).alias("x")).select("conv_id", "turn", "depth", "x.*").withColumn("words", _words(F.col("text")))
    # A few words link as a quotation of nothing else and as a message of nothing else, in hashes of their own.
    short = each.where((F.col("depth") > 0) & F.col("whole") & F.col("words").between(1, LEAST_WORDS - 1))
    said = rows.select("conv_id", "turn", F.lit(0).alias("depth"), _normal(F.col("body")).alias("text"), F.lit(False).alias("whole")).withColumn("words", _words(F.col("text")))
    few = short.unionByName(said.where(F.col("words").between(1, LEAST_WORDS - 1))).withColumn("key", F.xxhash64(F.lit("few"), "text"))
    both = each.where(F.col("words") >= LEAST_WORDS).withColumn("key", F.xxhash64("text")).unionByName(few)
    return both.groupBy("conv_id", "turn", "depth", "key").agg(F.max("words").alias("words"), F.max("whole").alias("whole"))


def quote_links(passages: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, words, source): each quoted key with the latest earlier message that has it unquoted.

    The latest one is found inside a range of turns, or is the last of the ranges before.
    """
    quoted = passages.where("depth > 0").select("conv_id", "turn", "depth", "key", "words")
    said = passages.where("depth = 0").join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").select("conv_id", "key", "turn")
    part = F.floor(F.col("turn") / RANGE).alias("part")
    both = said.select("conv_id", "key", "turn", part, F.col("turn").alias("origin"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("words"))
    both = both.unionByName(quoted.select("conv_id", "key", "turn", part, F.lit(None).cast("long").alias("origin"), "depth", "words"))
    last = both.groupBy("conv_id", "key", "part").agg(F.max("origin").alias("newest"))
    before = last.withColumn("before", F.max("newest").over(W.partitionBy("conv_id", "key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("newest")
    order = W.partitionBy("conv_id", "key", "part").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("inside", F.max("origin").over(order)).where("depth is not null").join(before, ["conv_id", "key", "part"])
    return found.select("conv_id", "turn", "depth", "words", F.coalesce("inside", "before").alias("source")).where("source is not null")


def _threads(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, reply_depth) of the messages with a parent: every round doubles how far they look up."""
    up = scratch.keep(parents.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("reply_depth")), "up-0")
    for i in range(1, 64):
        above = up.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("top"), F.col("reply_depth").alias("more"))
        jumped = up.join(above, ["conv_id", "thread_turn"], "left")
        moved = scratch.keep(jumped.select("conv_id", "turn", F.coalesce("top", "thread_turn").alias("thread_turn"), (F.col("reply_depth") + F.coalesce("more", F.lit(0))).alias("reply_depth"), F.col("top").isNotNull().alias("moved")), f"up-{i}")
        scratch.drop(f"up-{i - 1}")
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return up
    raise RuntimeError("reply chains did not settle")


def linked_conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """One row for every row of ``messages`` (conv_id, turn, role, text; others ignored), without its quotations.

    conv_id, turn, role, text, parent_turn (null where nothing quoted was found), thread_turn, reply_depth, n_quotes
    (different quoted passages that aren't blank) and n_linked (those and their parts that were found).  Null and empty
    texts are empty messages; a text of any length is read whole; rows without conv_id or turn are threads of their own;
    rows that repeat a conv_id and turn are one message in what was found for it, and a row each.  An empty table gives an
    empty result.
    """
    scratch = Scratch(spark, "quotes")
    rows = scratch.keep(parsed(messages), "parsed")
    named = rows.where("conv_id is not null and turn is not null")
    # Only conversations with a quotation have anything to find.
    quoting = scratch.keep(named.where("quotes").select("conv_id").distinct(), "quoting")
    passages = scratch.keep(_parts(named.join(quoting, "conv_id", "left_semi")), "passages")
    links = scratch.keep(quote_links(passages), "links")
    by_source = links.groupBy("conv_id", "turn", "depth", "source").agg(F.sum("words").alias("words"))
    best = by_source.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), "words", "source")).alias("best"))
    parents = scratch.keep(best.select("conv_id", "turn", F.col("best.source").alias("parent_turn")), "parents")
    threads = _threads(scratch, parents)
    quotes = passages.where("depth > 0 and whole").groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    found = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    out = rows.select("conv_id", "turn", "role", F.col("body").alias("text"))
    for more in (parents, threads, quotes, found):
        out = out.join(more, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_depth", zero).alias("reply_depth"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"))
