"""Chat formatting by quotation linking, in DataFrame operations only.

Messages are read line by line; a line's quote level is the number of leading '>' marks. Runs of lines of one level between blank
lines are passages: quoted ones above level zero, else own ones. Passages are normalised and hashed, and
quoted ones are joined to the messages that hold the same own passage, or else the same lines in a row: the latest earlier message of the
conversation, else the first message of another conversation. Replies follow what they quote, and quotes are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bind, lower_ascii, positions, stored

#: Leading quote marks with spaces between them.
MARKS = r"^(?:[ \t]*>)+"
#: The line by which mail programs announce a quotation.
INTRO = r"(?i)^.{0,200}\b(?:wrote|schrieb|écrit|escribió)\s*:\s*$"
NOTHING = ""


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def normalised(passage: Column) -> Column:
    """Lower case, words only, single spaces: what re-wrapping and punctuation do not change."""
    return F.btrim(F.regexp_replace(lower_ascii(passage), r"[^\p{L}\p{N}]+", " "))


def passages(text: Column) -> Column:
    """(level, body) in order: neighbouring lines of one level, cut at blank lines and at a line that announces the quotation behind it."""
    read = F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1),
        lambda line: F.struct(level_of(line).alias("level"), F.regexp_replace(line, MARKS + " ?", "").alias("body")),
    )

    # starts of passages, then the lines between them, so that a long message is not copied line by line
    def cut(lines: Column) -> Column:
        def starts_here(x: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            blank = F.btrim(x["body"], F.lit(SPACE_CHARS)) == ""
            announces = (x["level"] == 0) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(INTRO)
            return (i == 0) | F.coalesce(before["level"] != x["level"], F.lit(True)) | blank | announces

        starts = F.filter(F.transform(lines, lambda x, i: F.when(starts_here(x, i), i)), lambda i: i.isNotNull())

        def piece(s: Column) -> Column:
            return F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(lines, start)["level"].alias("level"),
                    F.array_join(F.transform(F.slice(lines, start + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - start), lambda x: x["body"]), "\n").alias("body"),
                ),
            )

        return bind(starts, piece)

    return bind(read, cut)


def line_hashes(passage: Column) -> Column:
    """The hashes of a passage's lines, those without words left out."""
    lines = F.transform(F.split(passage, "\n", -1), normalised)
    return F.transform(F.filter(lines, lambda x: x != NOTHING), lambda x: F.xxhash64(x))


def run_hash(lines: Column) -> Column:
    """One hash of the hashes of lines in a row."""
    return F.xxhash64(F.lit("lines"), lines)


def threaded(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, text without quotes, line, n_quotes, n_linked, quoted_conv, quoted_turn, thread, reply_order.

    quoted_*: the message that the first linked quotation comes from (null without one). thread: the turn at which the message's chain of
    quotations within the conversation begins, its own without one. reply_order: place in the conversation when threads
    stand by their first turn and messages of a thread by turn. line: "role: text". Nested levels are separate passages, so a
    quotation within a quotation finds its own source. A quotation of some lines of a passage, or of passages run together, is found by
    its lines, so it must not be wrapped anew as whole passages may. Messages without a conversation are not ordered: each has reply_order 1.
    Passages are told apart by 64-bit hashes of their words: among n passages two different ones are taken for one with chance n * n / 2**65.
    Columns other than the four named ones are not read. A null text is empty; empty passages link with nothing; messages with the same
    conversation and turn are one source but separate rows; null conversations or turns link with nothing.
    """
    rows = messages.select(
        *[F.col(f"`{c}`").alias(a) for c, a in ((conv_col, "conv"), (turn_col, "turn"))], F.col(f"`{role_col}`").cast("string").alias("role"), passages(F.col(f"`{text_col}`")).alias("ps")
    )
    quoted = F.filter(F.filter("ps", lambda p: p["level"] > 0), lambda p: normalised(p["body"]) != NOTHING)

    def quote(p: Column) -> Column:
        whole = F.xxhash64(normalised(p["body"]))
        return bind(line_hashes(p["body"]), lambda ls: F.struct(whole.alias("whole"), run_hash(ls).alias("run"), F.get(ls, F.lit(0)).alias("first"), F.get(ls, F.lit(1)).alias("second"), F.size(ls).alias("n")))

    own = F.filter("ps", lambda p: p["level"] == 0)
    kept = F.filter(own, lambda p: ~F.regexp_like(F.btrim(p["body"], F.lit(SPACE_CHARS)), F.lit(INTRO)) | (F.size(F.filter("ps", lambda q: q["level"] > 0)) == 0))
    rows = rows.select(
        "conv", "turn", "role",
        F.regexp_replace(F.btrim(F.array_join(F.transform(kept, lambda p: p["body"]), "\n"), F.lit(SPACE_CHARS)), "\n{3,}", "\n\n").alias("text"),
        F.transform(quoted, quote).alias("quotes"),
        F.array_distinct(F.transform(F.filter(F.transform(own, lambda p: normalised(p["body"])), lambda q: q != NOTHING), lambda q: F.xxhash64(q))).alias("own"),
        F.flatten(F.transform(own, lambda p: line_hashes(p["body"]))).alias("lines"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "chat-messages")

    known = rows.where("conv is not null and turn is not null")
    quotes = known.select("row", "conv", "turn", F.posexplode("quotes").alias("q", "x")).select("row", "conv", "turn", "q", "x.*")
    # places where a quotation's first two lines stand (its only one, if it has no more); the lines that follow are hashed there only
    begun = quotes.select("first", "second", "n").distinct()
    pairs = F.transform("lines", lambda x, i: F.struct(x.alias("first"), F.get("lines", i + 1).alias("second")))
    each = known.select("row", F.posexplode(pairs).alias("at", "x")).select("row", "at", "x.*")
    places = each.join(begun.where("n > 1"), ["first", "second"]).select("row", "at", "n")
    places = places.unionByName(each.drop("second").join(begun.where("n = 1").select("first", "n"), "first").select("row", "at", "n"))
    places = places.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("places"))
    runs = F.array_distinct(F.transform("places", lambda x: run_hash(F.slice("lines", x["at"] + 1, x["n"]))))
    told = known.select("conv", "turn", F.explode("own").alias("h"))
    told = told.unionByName(known.select("row", "conv", "turn", "lines").join(places, "row").select("conv", "turn", F.explode(runs).alias("h")))
    ways = F.posexplode(F.array("whole", "run")).alias("way", "h")
    asked = quotes.select("row", "conv", "turn", "q", ways)
    # only passages that someone quotes go on; a passage is one source a conversation and turn, however often it stands there
    wanted = asked.select("h").distinct()
    sources = told.join(wanted, "h").select("h", "conv", "turn").distinct()
    # within a conversation the last source before each asking turn, from one ordered run over both
    both = sources.withColumn("source", F.col("turn")).unionByName(asked.select("h", "conv", "turn").distinct().withColumn("source", F.lit(None).cast(rows.schema["turn"].dataType)))
    earlier = Window.partitionBy("h", "conv").orderBy("turn", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = both.withColumn("latest", F.max("source").over(earlier)).where("source is null").select("h", "conv", "turn", "latest")
    # the first two conversations, as one of them may be the asker's own
    first = sources.groupBy("h", "conv").agg(F.min("turn").alias("turn"))
    least = first.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("conv"))).where("place <= 2")
    anywhere = least.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("conv", "turn"))).alias("first"))
    near = asked.join(before, ["h", "conv", "turn"], "left").join(anywhere, "h", "left")
    latest = F.col("latest")
    elsewhere = F.get(F.filter("first", lambda x: x["conv"] != F.col("conv")), F.lit(0))
    found = near.withColumn("source", F.when(latest.isNotNull(), F.struct(F.col("conv").alias("conv"), latest.alias("turn"))).otherwise(elsewhere))
    # of one quotation: the conversation itself goes before others, and the whole passage before its lines
    found = found.where("source is not null").groupBy("row", "q").agg(F.min_by("source", F.struct(F.col("source.conv") != F.col("conv"), F.col("way"))).alias("source"))
    found = found.groupBy("row").agg(F.min_by("source", "q").alias("source"), F.count("*").alias("n_linked"))
    linked = stored(rows.select("row", "conv", "turn").join(found, "row"), "chat-linked")

    # the beginning of each chain within a conversation: parents are followed by doubling
    step = linked.where(F.col("source.conv") == F.col("conv")).groupBy("conv", "turn").agg(F.min("source.turn").alias("up"))
    step = stored(step, "chat-up-0")
    for turn in range(1, 64):
        over = step.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"))
        new = stored(step.join(over, ["conv", "up"], "left").select("conv", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), f"chat-up-{turn}")
        moved = new.where("moved").limit(1).count()
        step = new.select("conv", "turn", "up")
        if not moved:
            break

    out = rows.join(linked.select("row", "source", "n_linked"), "row", "left").join(step, ["conv", "turn"], "left")
    out = out.withColumn("thread", F.coalesce("up", "turn"))
    # places by ranges, so that a conversation of any length is dealt over tasks; a message without a conversation is one by itself
    k = F.coalesce(F.concat(F.lit("1"), F.col("conv").cast("string")), F.concat(F.lit("0"), F.col("row").cast("string")))
    out = positions(out.withColumn("k", k), [F.col(c) for c in ("thread", "turn", "role", "text")], "chat-places")
    place = F.col("idx") + 1
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "text",
        F.concat_ws(": ", F.coalesce("role", F.lit("user")), "text").alias("line"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("source.conv").alias("quoted_conv"), F.col("source.turn").alias("quoted_turn"),
        "thread", place.cast("long").alias("reply_order"),
    )
