"""Chat formatting into budgeted windows.

Turns get prefix sums of their tokens. The sums cut a conversation into turn-aligned spans; a window is a span
behind the system turn and as much repeated history as a limit allows. Each assistant turn is a target in the
window where it is new and masked where it is repeated. Everything is built-in Spark functions; the window
frames run over one conversation at a time.

Template of a turn: ``### role: text</turn>`` and a line feed. In texts and roles the characters that markers
start with are written as escapes (``\\`` as ``\\s``, ``#`` as ``\\h``, ``<`` as ``\\l``, in roles also ``:`` as
``\\c``), so no text can contain a marker and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 1024  # tokens of a window
HISTORY = 256  # tokens of repeated turns
_ESCAPES = (("#", r"\h"), ("<", r"\l"))
_BACKSLASH = ("\\", r"\s")
_END = "</turn>\n"


def escape(text: Column, more: tuple = ()) -> Column:
    for a, b in (_BACKSLASH, *_ESCAPES, *more):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, more: tuple = ()) -> Column:
    for a, b in (*_ESCAPES, *more, _BACKSLASH):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


_COLON = ((":", r"\c"),)


def estimated_tokens(text: Column) -> Column:
    """A count that needs no tokenizer: a quarter of the characters and four for the markers."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, loss, n_repeated): formatted windows of every conversation.

    ``turns`` has conv_id, turn, role and text; other columns are not read. ``loss`` lists the spans (start, end in
    code points) of new assistant texts; the first ``n_repeated`` turns of a window are repeats. A window keeps to
    the budget unless one turn alone goes beyond what the system turn and the history leave. A system turn counts
    as such at the start of a conversation. Null texts and roles are empty; null conversation ids make one
    conversation; equal or null turn numbers are ordered by role and text, and repeated rows stay; an empty
    table gives an empty one.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.withColumn("tokens", estimated_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    head = F.concat(F.lit("### "), escape(F.col("role"), _COLON), F.lit(": "))
    rows = rows.select("conv_id", "place", "role", "tokens", "system", F.length(head).alias("head"),
                       F.concat(head, escape(F.col("text")), F.lit(_END)).alias("turn_text"))
    own = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    placed = Window.partitionBy("conv_id").orderBy("place")
    before = placed.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "start": F.coalesce(F.sum(own).over(before), F.lit(0)),
        "room": F.greatest(F.lit(2), F.lit(budget - history) - F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)),
        "system_text": F.max(F.when(F.col("system"), F.col("turn_text"))).over(whole),
    })
    # Short turns share a span of half the room by prefix sum, so a span ends within the room; a long one stands alone.
    half = F.floor(F.col("room") / 2)
    rows = rows.withColumn("long", ~F.col("system") & (F.col("tokens") > F.col("room") - half))
    rows = rows.withColumns({"cell": F.floor(F.col("start") / half), "earlier": F.max("system").over(before)})
    lag = lambda c: F.lag(c).over(placed)
    opens = ~F.col("system") & (lag("place").isNull() | lag("system") | F.col("long") | lag("long") | (lag("cell") != F.col("cell")))
    rows = rows.withColumn("opens", opens).drop("earlier")
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("long")).over(placed.rowsBetween(Window.unboundedPreceding, 0)))
    # Windows that open within ``history`` tokens behind the start of a turn repeat it.
    behind = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    later = F.collect_list(F.when(F.col("opens"), F.col("window"))).over(behind)
    alone = F.col("system") & (F.max("window").over(whole) == 0)  # a conversation of nothing but its system turn
    rows = rows.withColumns({"later": F.when(F.col("system"), F.array().cast("array<bigint>")).otherwise(later), "alone": alone})
    rows = rows.where(~F.col("system") | F.col("alone"))
    rows = rows.withColumn("window", F.explode(F.concat(F.array("window"), "later"))).withColumn(
        "repeated", F.array_position("later", F.col("window")) > 0)
    inside = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.when(F.col("alone"), 0).otherwise(F.coalesce(F.length("system_text"), F.lit(0)))
    rows = rows.withColumn("offset", lead + F.coalesce(F.sum(F.length("turn_text")).over(inside), F.lit(0)) + F.col("head"))
    target = ~F.col("repeated") & (F.col("role") == "assistant")
    span = F.when(target, F.struct(F.col("offset").alias("start"),
                                   (F.col("offset") + F.length("turn_text") - F.col("head") - len(_END)).alias("end")))
    made = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("place", "turn_text"))).alias("parts"),
        F.sort_array(F.collect_list(span)).alias("loss"),
        F.first("system_text").alias("system_text"), F.first("alone").alias("alone"),
        F.sum(F.col("repeated").cast("int")).alias("n"))
    with_system = F.col("system_text").isNotNull() & ~F.col("alone")
    return made.select(
        "conv_id", "window",
        F.concat(F.when(with_system, F.col("system_text")).otherwise(""), F.array_join(F.col("parts")["turn_text"], "")).alias("text"),
        "loss", (F.col("n") + F.when(with_system & (F.col("window") > 1), 1).otherwise(0)).alias("n_repeated"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the formatted windows say: its turns without repeats and the text under the loss mask.

    (conv_id, turns array of (role, text), loss string, formatted_chars).
    """
    parts = F.filter(F.split("text", _END), lambda p: p != "")
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - F.col("n_repeated"), F.lit(0)))

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(5))
        role = F.substring_index(body, ": ", 1)
        return F.struct(unescape(role, _COLON).alias("role"), unescape(F.substr(body, F.length(role) + 3)).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    rows = formatted.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("n"))
    return rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("n").alias("formatted_chars")
    ).select("conv_id", F.flatten("all.turns").alias("turns"), F.array_join("all.loss", "").alias("loss"), "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    rows = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
