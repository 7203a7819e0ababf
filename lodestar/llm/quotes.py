"""Quotation linking: nested quotes to their originals, and conversations in reply order without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import with_latest_before
from .common import HOT, spread_join, stored

#: Turns of a conversation that one task looks through at a time.
STRETCH = 1024


def normalised(text: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _digest(text: Column) -> Column:
    """128 bits of a normalised passage's digest."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _hash(text: Column) -> Column:
    return _digest(normalised(text))


def passages(text: Column) -> Column:
    """A text's passages in order, as (level, text): stretches of lines under the same number of quote marks.

    A line's level is the number of ``>`` at its start, each with a blank after
    it or not; level 0 is the writer's own.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _line)
    starts = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i - 1)["level"] != F.get(ls, i)["level"]))

    def cut(ls: Column) -> Column:
        return F.transform(F.array(starts(ls)), lambda at: F.transform(at, lambda s, i: F.struct(F.get(ls, s)["level"].alias("level"), F.array_join(F.transform(F.slice(ls, s + 1, F.coalesce(F.get(at, i + 1), F.size(ls)) - s), lambda x: x["text"]), "\n").alias("text"))))[0]

    return F.transform(F.array(lines), cut)[0]


def _line(line: Column) -> Column:
    marks = F.regexp_extract(line, "^((?:>[ ]?+)*+)", 1)
    return F.struct(F.char_length(F.replace(marks, F.lit(" "), F.lit(""))).alias("level"), F.substr(line, F.char_length(marks) + 1, F.char_length(line)).alias("text"))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, parts, quotes): each message's own text, its passages, and the quoted ones that hold anything."""
    found = messages.select("conv_id", "turn", "role", passages(F.col("text").cast("string")).alias("all"))
    parts = F.transform(F.filter("all", lambda p: p["level"] == 0), lambda p: p["text"])
    quotes = F.filter("all", lambda p: (p["level"] > 0) & (normalised(p["text"]) != ""))
    return found.select("conv_id", "turn", "role", F.array_join(parts, "\n").alias("own"), parts.alias("parts"), quotes.alias("quotes"))


def _lines(text: Column) -> Column:
    """The lines of a text that hold anything, normalised."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def _runs(lines: Column) -> Column:
    """All runs of 2, 4, 8 ... of two lines or more, as (k, p, h): 2^k lines from place p on, and their 64-bit hash out of the halves' hashes."""
    none = F.array().cast("array<struct<k:int,p:int,h:bigint>>")

    def doubled(acc: Column, k: Column) -> Column:
        half = F.pow(F.lit(2), k - 1).cast("int")
        heads = F.slice(acc["now"], F.lit(1), F.size(acc["now"]) - half)
        now = F.transform(heads, lambda h, i: F.xxhash64(h, F.get(acc["now"], i + half)))
        return F.transform(F.array(now), lambda n: F.struct(n.alias("now"), F.concat(acc["all"], F.transform(n, lambda h, i: F.struct(k.cast("int").alias("k"), i.cast("int").alias("p"), h.alias("h")))).alias("all")))[0]

    start = F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("now"), none.alias("all"))
    return F.aggregate(F.sequence(F.lit(1), _doublings(lines)), start, doubled, lambda acc: acc["all"])


def _doublings(lines: Column) -> Column:
    return F.char_length(F.bin(F.size(lines).cast("long"))) - 1


def quoted_runs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, hash): the quoted passages of two lines or more that stand in a message's own text as consecutive lines.

    Blank lines do not count. A run of n lines is its first and its last 2^k
    lines, the largest power that fits, at their distance in one text; equal
    texts and equal passages are looked at once. A text first gives its own runs
    of the lengths that are quoted with their beginning, and those meet the
    quotes as a whole: many passages that begin alike do not meet each other.
    """
    several = lambda df: df.where(F.size("lines") >= 2)
    # lines stand behind a generator, so that a filter on them is not moved down and works them out again
    once = lambda text: F.explode(F.array(_lines(text))).alias("lines")
    quotes = several(messages.select(F.explode("quotes").alias("quote")).select(_hash(F.col("quote.text")).alias("hash"), once(F.col("quote.text")))).distinct()
    at = lambda place: F.filter("runs", lambda r: (r["k"] == F.col("k")) & (r["p"] == place))[0]["h"]
    apart = (F.size("lines") - F.pow(F.lit(2), F.col("k")).cast("int")).alias("apart")
    quotes = quotes.select("hash", "lines", _doublings(F.col("lines")).alias("k"), _runs(F.col("lines")).alias("runs")).select("hash", "k", "runs", apart)
    quotes = quotes.select("hash", "k", "apart", at(F.lit(0)).alias("head"), at(F.col("apart")).alias("tail")).distinct()
    texts = several(messages.select("conv_id", "turn", once(F.col("own")))).withColumn("own_hash", F.unhex(F.substring(F.sha2(F.array_join("lines", "\n").cast("binary"), 256), 1, 32)))
    posts = texts.select("own_hash", "lines").dropDuplicates(["own_hash"]).select("own_hash", F.explode(_runs(F.col("lines"))).alias("run")).select("own_hash", "run.*")
    heads = posts.withColumnRenamed("h", "head").join(quotes.select("k", "head", "apart").distinct(), ["k", "head"]).select("own_hash", "k", "head", "apart", (F.col("p") + F.col("apart")).alias("p"))
    runs = heads.join(posts.withColumnRenamed("h", "tail"), ["own_hash", "k", "p"]).select("own_hash", "k", "head", "apart", "tail").distinct()
    whole = runs.join(quotes, ["k", "head", "apart", "tail"]).select("hash", "own_hash").distinct()
    return texts.select("conv_id", "turn", "own_hash").join(whole, "own_hash").select("conv_id", "turn", "hash")


def linked(messages: DataFrame) -> DataFrame:
    """A row per quoted passage that an earlier message holds: (conv_id, turn, place, level, source), ``source`` being (conv_id, turn).

    A message can be quoted as a whole, by a stretch of its own between quotes,
    by a paragraph, or by any of its lines that follow each other. The latest
    earlier message of the same conversation is taken; failing that the first
    of all messages that hold the passage, if it comes before. Passages that
    nobody holds give no row.
    """
    quotes = messages.select("conv_id", "turn", F.posexplode("quotes").alias("place", "quote")).select("conv_id", "turn", "place", "quote.level", _hash(F.col("quote.text")).alias("hash"))
    paragraphs = F.flatten(F.transform("parts", lambda p: F.split(p, r"\n\s*\n")))
    pieces = F.array_distinct(F.transform(F.array_distinct(F.concat(F.split("own", "\n"), F.col("parts"), paragraphs, F.array("own"))), normalised))
    originals = messages.select("conv_id", "turn", F.explode(F.array_remove(pieces, "")).alias("piece")).select("conv_id", "turn", _digest(F.col("piece")).alias("hash")).unionByName(quoted_runs(messages))
    originals = stored(originals, "passages")
    # what nobody quotes in a conversation goes before the rest is looked through
    here = originals.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    both = quotes.select("conv_id", "turn", "hash", "place", "level", F.lit(1).alias("kind")).unionByName(here.select("conv_id", "turn", "hash", F.lit(-1).alias("place"), F.lit(0).alias("level"), F.lit(0).alias("kind")))
    # quotes of a turn stand before its own pieces: no message quotes itself
    at = both.withColumn("after", F.col("kind") == 0)
    near = with_latest_before(at, ["conv_id", "hash"], F.floor(F.col("turn") / STRETCH), ["turn", "after", "place"], F.col("kind") == 0, F.struct("conv_id", "turn"), "source")
    near = stored(near.where(F.col("kind") == 1).select("conv_id", "turn", "place", "level", "hash", "source"), "near-sources")
    found, open_ = near.where(F.col("source").isNotNull()).drop("hash"), near.where(F.col("source").isNull()).drop("source")
    asked = open_.groupBy("hash").agg(F.count("*").alias("n"))
    if asked.isEmpty():
        return found
    first = stored(originals.join(asked, "hash").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("source"), F.max("n").alias("n")), "first-sources")
    far = spread_join(open_, first, "hash", F.col("n") * HOT > near.count()).where(F.col("source") < F.struct("conv_id", "turn"))
    return found.unionByName(far.select(found.columns))


def replies(messages: DataFrame) -> DataFrame:
    """Conversations in reply order: every message of ``messages`` (conv_id, turn, role, text) with its own text.

    Columns: conv_id, turn, role, own, n_quotes, n_linked, parent_conv,
    parent_turn (the latest message that a passage of level 1 quotes),
    thread_conv, thread_turn (the message at the root), depth, and position in
    the thread from 0: replies stand behind what they reply to, by depth and
    then by conversation and turn. Roots are found by doubling: each round
    joins every message to its ancestor's ancestor.

    Defined results: null and empty texts have no quotes and cannot be quoted;
    a message without a linked passage is a root; a parent always comes earlier
    by (conv_id, turn); rows that repeat a (conv_id, turn) count once; rows
    without conv_id or turn are roots of depth 0 at position null; an empty
    table gives no rows; other columns are ignored.
    """
    unique = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    named = unique.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).dropDuplicates(["conv_id", "turn"])
    known = stored(parsed(named), "parsed-messages")
    links = linked(known).groupBy("conv_id", "turn").agg(F.count("source").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source"))).alias("parent"))
    base = stored(known.join(links, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "own", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn")), "linked-messages")
    placed = base.join(_roots(base), ["conv_id", "turn"])
    level = ["thread_conv", "thread_turn", "depth"]
    before = F.sum("n").over(Window.partitionBy("thread_conv", "thread_turn").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy(*level).agg(F.count("*").alias("n")).select(*level, F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy(*level).orderBy("conv_id", "turn")) - 1
    ordered = placed.withColumn("at", at).join(sizes, level).withColumn("position", (F.col("before") + F.col("at")).cast("long")).drop("at", "before")
    loose = parsed(unique.where(F.col("conv_id").isNull() | F.col("turn").isNull())).select("conv_id", "turn", "role", "own", F.size("quotes").cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"))
    return ordered.unionByName(loose, allowMissingColumns=True)


def _roots(base: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_conv, thread_turn, depth) of every message."""
    is_root = F.col("parent_conv").isNull()
    state = base.select("conv_id", "turn", F.when(is_root, F.col("conv_id")).otherwise(F.col("parent_conv")).alias("up_conv"), F.when(is_root, F.col("turn")).otherwise(F.col("parent_turn")).alias("up_turn"), F.when(is_root, 0).otherwise(1).cast("long").alias("depth"), is_root.alias("done"))
    while True:
        state = stored(state, "reply-roots")
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            return state.select("conv_id", "turn", F.col("up_conv").alias("thread_conv"), F.col("up_turn").alias("thread_turn"), "depth")
        above = state.select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("next_conv"), F.col("up_turn").alias("next_turn"), F.col("depth").alias("more"), F.col("done").alias("above_done"))
        moved = open_.join(above, ["up_conv", "up_turn"]).select("conv_id", "turn", F.col("next_conv").alias("up_conv"), F.col("next_turn").alias("up_turn"), (F.col("depth") + F.col("more")).alias("depth"), F.col("above_done").alias("done"))
        state = state.where("done").unionByName(moved)


def quoting(conversations: DataFrame, levels: int = 2, style: str = "whole") -> DataFrame:
    """Conversations as mail writes them: each turn quotes the turn before, and that one's quotes, to ``levels`` levels.

    Style ``part`` quotes the turn before without its first line and, of four
    lines or more, its last; ``interleaved`` quotes the first half of its lines
    ahead of the first half of the own ones, and the rest ahead of the rest.
    Both quote one level.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if style == "whole":
        quoted = [F.concat(F.lit("> " * n), F.replace(F.lag(text, n).over(order), F.lit("\n"), F.lit("\n" + "> " * n))) for n in range(levels, 0, -1)]
        return conversations.select("conv_id", "turn", "role", F.concat_ws("\n", *quoted, text).alias("text"))
    lines = conversations.select("conv_id", "turn", "role", F.split(text, "\n").alias("own"), F.split(F.lag(text).over(order), "\n").alias("before"))
    marked = lambda ls: F.transform(ls, lambda x: F.concat(F.lit("> "), x))
    before, n = F.coalesce("before", F.array().cast("array<string>")), F.size(F.coalesce("before", F.array().cast("array<string>")))
    if style == "part":
        some = F.when(n >= 4, F.slice(before, F.lit(2), F.greatest(n - 2, F.lit(0)))).when(n >= 2, F.slice(before, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(before)
        return lines.select("conv_id", "turn", "role", F.array_join(F.concat(marked(some), F.col("own")), "\n").alias("text"))
    half = lambda ls: F.ceil(F.size(ls) / 2).cast("int")
    first = lambda ls: F.slice(ls, F.lit(1), half(ls))
    rest = lambda ls: F.slice(ls, half(ls) + 1, F.size(ls))
    return lines.select("conv_id", "turn", "role", F.array_join(F.concat(marked(first(before)), first(F.col("own")), marked(rest(before)), rest(F.col("own"))), "\n").alias("text"))
