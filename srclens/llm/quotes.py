"""Quotation linking and reply-ordered conversations.

Lines that begin with ``>`` marks are quoted, as many levels deep as there are
marks; a line that introduces a quotation ("On ... wrote:") belongs to it.
Paragraphs, and single lines for partly quoted ones, are normalised and hashed,
and each quoted one is linked to the latest earlier message of its conversation
that says it in its own words.  A message replies to the latest message it quotes
at the first level; a thread is what its replies lead back to.

The link is an as-of join: for each conversation and hash a running maximum of the
turn, over ranges of ``RANGE`` turns with what came before carried in, so neither
a common line nor a long conversation is one task's work, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.llm.common import table, written

RANGE = 4096
BLANK = r"[ \t\x0B\f\r]"
MARKS = rf"^{BLANK}*(?:>{BLANK}*)+"
INTRODUCTION = r"^(On|Am|Le|El) .*(wrote|schrieb[^:]*|a écrit|escribió)[ \t]?:[ \t]*$"


def _lines(text: Column) -> Column:
    """Lines as (depth, said): the number of leading marks, and what follows them."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"),
                        F.regexp_replace(line, MARKS, "").alias("said"))

    return F.transform(lines, parsed)


def _own(line: Column, following: Column) -> Column:
    introduces = line["said"].rlike(INTRODUCTION) & (F.coalesce(following["depth"], F.lit(0)) > 0)
    return (line["depth"] == 0) & ~introduces


def normalised(text: Column) -> Column:
    """Lower case, white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """Messages with ``mid``, ``lines`` (no, depth, said; introductions have depth null) and ``own_text``.

    Equal rows are one message.  A null turn or conversation counts as -1.
    """
    rows = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("raw", _lines(F.col("text")))
    rows = rows.withColumn("lines", F.transform("raw", lambda x, i: F.struct(
        i.alias("no"),
        F.when(_own(x, F.get("raw", i + 1)) | (x["depth"] > 0), x["depth"]).alias("depth"), x["said"].alias("said"))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["depth"] == 0), lambda x: x["said"]), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return rows.select(
        "conv_id", "turn", "role", F.xxhash64("conv_id", "turn", "role", "text").alias("mid"), "lines",
        own.alias("own_text"))


def units(parsed: DataFrame) -> DataFrame:
    """Paragraphs and lines that are hashed: (conv_id, turn, mid, depth, unit, kind, hash).

    A paragraph is a run of lines of one depth without a blank one between; ``unit``
    is the number of its first line.  A paragraph of one line is a paragraph only.
    """
    rows = parsed.select("conv_id", "turn", "mid", F.explode("lines").alias("l")).select(
        "conv_id", "turn", "mid", "l.no", "l.depth", "l.said")
    empty = F.trim(F.regexp_replace("said", r"\s+", " ")) == ""
    by_message = Window.partitionBy("mid").orderBy("no")
    before = F.lag(F.when(empty, -1).otherwise(F.coalesce("depth", F.lit(-1)))).over(by_message)
    starts = F.when(F.coalesce(before, F.lit(-1)) != F.col("depth"), 1).otherwise(0)
    rows = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(by_message))
    rows = rows.where(F.col("depth").isNotNull() & ~empty)
    whole = rows.groupBy("conv_id", "turn", "mid", "depth", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "said"))), lambda x: x["said"]), " ").alias("said"),
        F.min("no").alias("unit"), F.count("*").alias("many"))
    paragraphs = whole.select("conv_id", "turn", "mid", "depth", "unit", F.lit("paragraph").alias("kind"), "said", "run")
    lines = rows.join(whole.where("many > 1").select("mid", "run"), ["mid", "run"]).select(
        "conv_id", "turn", "mid", "depth", F.col("no").alias("unit"), F.lit("line").alias("kind"), "said", "run")
    return paragraphs.unionByName(lines).select(
        "conv_id", "turn", "mid", "depth", "unit", "kind", "run", F.md5(normalised(F.col("said")).cast("binary")).alias("hash"))


def links(found: DataFrame) -> DataFrame:
    """Quoted units with ``target``: the latest earlier turn that says them itself (null: none).

    ``found``: the rows of ``units``.
    """
    key = ["conv_id", "hash"]
    quoted = found.where("depth > 0")
    said = found.where("depth = 0").select(*key, "turn").join(
        quoted.select(*key).distinct(), key, "left_semi").distinct()
    part = F.floor(F.col("turn") / RANGE)
    latest = said.groupBy(*key, part.alias("part")).agg(F.max("turn").alias("last"))
    asked = quoted.withColumn("part", part)
    # What earlier ranges said, for each range in which something is asked or said.
    ranges = latest.unionByName(asked.select(*key, "part", F.lit(None).cast("long").alias("last"))).groupBy(
        *key, "part").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("carried", F.max("last").over(earlier)).select(*key, "part", "carried")
    events = said.withColumn("part", part).select(
        *key, "part", "turn", F.col("turn").alias("spoken"), F.lit(None).cast("struct<mid:bigint,depth:int,unit:int,kind:string,run:bigint>").alias("ask"))
    events = events.unionByName(asked.select(
        *key, "part", "turn", F.lit(None).cast("long").alias("spoken"),
        F.struct("mid", F.col("depth").cast("int").alias("depth"), F.col("unit").cast("int").alias("unit"), "kind", "run").alias("ask")))
    # Range, not rows: what is said in the same turn is not earlier.
    seen = Window.partitionBy(*key, "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("here", F.max("spoken").over(seen)).where("ask IS NOT NULL").join(carried, [*key, "part"])
    return out.select("conv_id", "turn", "ask.*", "hash", F.coalesce("here", "carried").alias("target"))


def linked(found: DataFrame) -> DataFrame:
    """The links of ``links`` that count: lines only where their paragraph as a whole has none."""
    all_links = written(links(found))
    whole = all_links.where("kind = 'paragraph'")
    bare = all_links.where("kind = 'line'").join(
        whole.where("target IS NOT NULL").select("mid", "run"), ["mid", "run"], "left_anti")
    return whole.unionByName(bare.where("target IS NOT NULL").select(whole.columns))


def roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root) for (conv_id, turn, parent_turn): where the replies lead, by doubling."""
    now = written(replies.select("conv_id", "turn", F.col("parent_turn").alias("root")))
    while now.take(1):
        onward = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"))
        after = written(now.join(onward, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = after.drop("moved")
        if not after.where("moved").take(1):
            break
    return now


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each distinct message of ``messages`` (conv_id, turn, role, text), without its quotes.

    conv_id, turn, role, own_text, own_hash (of the normalised own text), n_quotes
    (quoted paragraphs), n_linked (those linked, in whole or by a line), depth (of
    the deepest quote), parent_turn (null: no reply), thread_turn (the turn the
    thread begins with) and position (from 1, in reply order: a reply comes after
    what it replies to).  Messages of one turn are ordered by role and text.
    """
    parsed = written(parse(messages))
    counted = written(linked(written(units(parsed))))
    per_message = counted.groupBy("mid").agg(
        F.count_if(F.col("kind") == "paragraph").alias("n_quotes"),
        F.count_distinct(F.when(F.col("target").isNotNull(), F.col("run"))).alias("n_linked"),
        F.max("depth").alias("depth"), F.max(F.when(F.col("depth") == 1, F.col("target"))).alias("parent_turn"))
    rows = written(parsed.select("conv_id", "turn", "role", "mid", "own_text").join(per_message, "mid", "left"))
    replies = rows.where("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn"))
    rows = rows.join(roots(replies), ["conv_id", "turn"], "left").withColumn(
        "thread_turn", F.coalesce("root", "turn")).withColumn("part", F.floor(F.col("turn") / RANGE))
    thread = ["conv_id", "thread_turn"]
    before = written(rows.groupBy(*thread, "part").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(
        F.sum("many").over(Window.partitionBy(*thread).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("many"))
    place = F.row_number().over(Window.partitionBy(*thread, "part").orderBy("turn", "role", "own_text", "mid"))
    return rows.withColumn("place", place).join(before, [*thread, "part"]).select(
        "conv_id", "turn", "role", "own_text", F.md5(normalised(F.col("own_text")).cast("binary")).alias("own_hash"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "parent_turn", "thread_turn",
        (F.col("before") + F.col("place")).alias("position"))


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_quotation_links": op1_quotation_links}
ORACLES: dict[str, str] = {}
