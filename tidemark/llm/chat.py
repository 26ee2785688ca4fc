"""Chat formatting: final messages from an event log, rendered with a loss mask, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on: no control string is left, and nothing is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, kind, role, text).

    Events of a conversation apply in the order of seq. ``delta`` adds text to its message, ``edit``
    replaces the message's text, ``regenerate`` does so too and takes back every later message
    that is there by then. An unknown or null kind counts as delta. The role is that of the last
    event that gives one. Null text or role: empty. Null conv_id: one conversation. Null seq or
    message comes first. Equal seq: by kind, role and text. Repeated events apply each time. Empty
    log: no messages.

    One shuffle by conversation serves all windows and the grouping.
    """
    at = F.struct("seq", "kind", "role", "text")
    resets = F.col("kind").isin("edit", "regenerate")
    log = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("kind"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "message").orderBy(F.desc("seq"), F.desc("kind"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    alive = log.select(
        "*",
        F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later).alias("back_to"),
        F.max(F.when(resets, 1).otherwise(0)).over(same).alias("reset"),
    ).where("(back_to IS NULL OR message IS NULL OR back_to >= message) AND coalesce(reset, 0) = 0")
    parts = F.transform(F.array_sort(F.collect_list(at)), lambda e: e["text"])
    return alive.groupBy("conv_id", "message").agg(F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), at)), F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans: the template's text and the character spans (start from 0, length) that bear loss.

    Control strings inside texts and roles are escaped reversibly, so no text can open or close a turn.

    A conversation is one row, so its messages meet in one task, and its text must fit into it. Null conv_id: one
    conversation. Null text or role: empty. Null message comes first; equal ones by their text. Repeated rows: each is a turn. Empty table:
    empty result. Extra columns aren't read.
    """
    messages = messages.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    pieces = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message", "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role").isin(*loss_roles), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turns = pieces.select("conv_id", F.struct("message", "piece", span.alias("span")).alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; null for null, empty for an empty one."""

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 2 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return bind(F.split(formatted, r"<\|im_start\|>", -1), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), turn))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask: that of the spans in their order, nothing between; null if text or spans are null, empty without spans."""
    return bind(formatted, lambda f: F.array_join(F.transform(spans, lambda s: unescape(F.substr(f, s["start"].cast("int") + 1, s["length"].cast("int")))), ""))


def conversation_events(turns: DataFrame, *, drafts: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the log of a client that streams: each row, in turn order, is a message of its own.

    A message comes as a delta of its first half that an edit takes back, an edit that brings that half again, and a
    delta of the rest; for roles in ``drafts`` a regeneration stands for the second edit. Folding the log gives the turns again.

    Null conv_id: one conversation. Null turns come first, equal ones by role and text. Null text: empty. Null role: stays null.
    Repeated rows: messages of their own. Empty table: empty log. Extra columns aren't read. A conversation is numbered in one task.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    steps = [("delta", first), ("edit", F.lit("")), (F.when(F.col("role").isin(*drafts), "regenerate").otherwise("edit"), first), ("delta", rest)]
    kinds = [F.lit(k) if isinstance(k, str) else k for k, _ in steps]
    events = F.array(*[F.struct(F.lit(i).alias("step"), k.alias("kind"), t.alias("text")) for i, (k, (_, t)) in enumerate(zip(kinds, steps, strict=True))])
    numbered = turns.select("conv_id", place.alias("message"), "role", "text")
    log = numbered.select("conv_id", "message", "role", F.explode(events).alias("e"))
    return log.select("conv_id", (F.col("message") * len(steps) + F.col("e.step")).alias("seq"), "message", "e.kind", "role", "e.text")
