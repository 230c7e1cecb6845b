"""Chat formatting from event logs, with built-in functions only.

Events are partitioned by message, ordered by ``seq`` and folded: a ``message``
opens a message, a ``delta`` appends to it, an ``edit`` or a ``regenerate``
replaces what it said so far. Final messages are rendered in segments of
``SEGMENT`` numbers, so no task has to hold a whole conversation's events; a
conversation is the concatenation of its segments.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a
backslash becomes two and ``<|`` becomes ``<\\|``, so no control string is left
in them, and the original can be had back; roles also write line ends as
``\\n``. The loss mask is a list of spans of code points, one for each
assistant's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
SEGMENT = 64
EVENTS = "conv_id long, seq long, msg_id long, event string, role string, text string"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(text: Column) -> Column:
    """``\\n`` is a line end unless its backslash is the second of a pair."""
    lines = F.regexp_replace(text, r"\G((?:[^\\]|\\[\\|])*+)\\n", "$1\n")
    return unescape(lines)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg_id, nth, role, text.

    Messages are in the order of msg_id, and of their opening if several open
    under one msg_id. Null texts are empty; a null event counts as ``message``;
    changes before any opening open a message themselves. Of events with equal
    seq, openings come first, then ties go by event, role and text. Deleted
    content is what a later edit or regeneration of the same message replaces.
    """
    kind = F.coalesce("event", F.lit("message"))
    rank = F.when(kind == "message", 0).when(kind.isin("edit", "regenerate"), 1).otherwise(2)
    rows = events.select("conv_id", "msg_id", "seq", kind.alias("event"), rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "msg_id").orderBy("seq", "rank", "event", "role", F.xxhash64("text"))
    opened = F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(order)
    rows = rows.select("*", F.greatest(opened, F.lit(1)).alias("nth"), place.alias("place"))
    group = Window.partitionBy("conv_id", "msg_id", "nth").orderBy("place")
    reset = F.max(F.when(F.col("rank") < 2, F.col("place"))).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    role = F.first(F.when(F.col("role") != "", F.col("role")), ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select("conv_id", "msg_id", "nth", "place", "text", F.coalesce(role, F.lit("")).alias("role"), F.coalesce(reset, F.lit(0)).alias("reset")).where("place >= reset")
    return rows.groupBy("conv_id", "msg_id", "nth").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"))


def render_segments(messages: DataFrame) -> DataFrame:
    """conv_id, segment, formatted, loss_spans (start and length in code points of ``formatted``)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct("msg_id", "nth", F.concat(head, body, F.lit(END)).alias("turn"), F.length(head).alias("skip"), F.when(F.col("role") == "assistant", F.length(body)).alias("loss"))
    segment = F.floor(F.col("msg_id") / SEGMENT).cast("long")
    turns = messages.groupBy("conv_id", segment.alias("segment")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        zero,
        lambda s, t: F.struct(
            (s["at"] + F.length(t["turn"])).alias("at"),
            F.when(t["loss"].isNotNull(), F.concat(s["spans"], F.array(F.struct((s["at"] + t["skip"]).alias("start"), t["loss"].alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return turns.select("conv_id", "segment", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Segments of all conversations in ``events``; see :func:`fold_events` for odd rows.

    An empty table gives no rows, repeated ``message`` rows a turn each; other
    columns are ignored; a null conv_id is a conversation of its own.
    """
    return render_segments(fold_events(events))


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted output says of each conversation, and what lies under the loss mask."""
    turns = F.transform(
        F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.lit(1), F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1),
        lambda t: F.struct(
            unescape_role(F.substring(F.substring_index(t, "\n", 1), F.lit(len(START) + 1), F.length(t))).alias("role"),
            unescape(F.substring(t, F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t))).alias("text"),
        ),
    )
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    parts = segments.select("conv_id", F.struct("segment", F.size(turns).alias("n"), said.alias("said"), loss.alias("loss"), F.length("formatted").alias("chars")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    join = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    total = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p[name])
    return whole.select("conv_id", total("n").alias("n_turns"), join("said").alias("said"), join("loss").alias("loss"), total("chars").alias("formatted_chars"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as events: each row opens the message of its turn."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("msg_id"), F.lit("message").alias("event"), "role", "text")
