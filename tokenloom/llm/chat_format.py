"""Operator 1: chat formatting from event logs, with DataFrame functions only.

A log holds events of conversations: ``message`` (opens a turn with a text), ``delta`` (appends streamed text),
``edit`` (replaces the text so far) and ``regenerate`` (drops the text so far; deltas follow). Logs are
grouped by conversation and message, sorted by sequence, and folded: the text of a message is what follows
its last reset. Messages are then put in order and rendered. A conversation is one row of the result, so it has
to fit into one; messages are folded apart from each other first, which spreads long conversations.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and roles, ``<`` with any number of
backslashes before ``|`` gets one more backslash, so no control string is left and taking one away restores the text;
line ends in roles become ``<n>`` in the same manner. The loss mask is the list of the assistant texts' spans.

Defined results: null text or role is empty; a null sequence sorts first; a second ``message`` event of one message opens a turn of
its own, with its own text and role, which later events then change; the role of a turn is the first one that its events name; turns at equal
places are ordered by role and text; rows with equal keys in a table of turns are turns of their own; a null conversation id is a
conversation of its own; an empty log gives an empty result; texts of any length are rendered whole; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")


#: Characters of the abandoned draft in a log made from finished turns; pieces in which its texts are streamed.
DRAFT, PIECES = 24, 3


def events_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """A log that a table of finished turns could come from, for ``fold`` with the keys ``MESSAGE``.

    A trained role's text is streamed: a draft's delta, a regeneration, then the text in ``PIECES`` deltas. Others are a draft, edited once.
    Rows that are equal in all four columns are counted and numbered (``copy``); the number keeps their events apart.
    """
    # injective: the role's length tells where the text begins
    r, x = F.coalesce(turns[role], F.lit("")), F.coalesce(turns[text], F.lit(""))
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].cast("long").alias("turn"), r.alias("role"), x.alias("text"))
    of = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # dealt by keys that the fold groups by too, so the events aren't exchanged again
    n = rows.withColumn("of", of).groupBy("conv_id", "turn", "of").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    each = n.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    size = F.ceil(F.length("text") / PIECES).cast("int")
    event = lambda k, kind, role, text: F.struct(F.lit(k).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    draft = F.substring("text", 1, DRAFT)
    pieces = [event(3 + k, "delta", none, F.substring(F.col("text"), size * k + 1, size)) for k in range(PIECES)]
    streamed = F.array(event(1, "delta", F.col("role"), draft), event(2, "regenerate", none, none), *pieces)
    edited = F.array(event(1, "message", F.col("role"), draft), event(2, "edit", none, F.col("text")))
    log = each.withColumn("e", F.explode(F.when(F.col("role") == trained, streamed).otherwise(edited)))
    return log.select("conv_id", "turn", "of", "copy", F.col("turn").alias("place"), "e.*")


#: The columns that name a message of ``events_of_turns``.
MESSAGE = ("turn", "of", "copy")


def fold(events: DataFrame, message: tuple[str, ...] = ("message",), place: str | None = None) -> DataFrame:
    """events (conv_id, seq, message columns, kind, role, text) -> messages (conv_id, place, opened, role, text).

    message: the columns that name a message within its conversation. place: the column that orders messages; by
    default the sequence of a turn's first event does. opened: which ``message`` event of the message began this turn.
    """
    e = F.struct(F.col("seq"), F.when(F.col("kind") == "delta", 1).otherwise(0).alias("late"), F.col("kind"), F.col("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = [F.first(place).alias("place")] if place else []
    log = events.groupBy("conv_id", *message).agg(F.sort_array(F.collect_list(e)).alias("log"), *own)
    # each message event after another one begins a turn of its own
    starts = F.filter(F.transform("log", lambda x, i: F.when(x["kind"] == "message", i)), lambda i: i.isNotNull())
    log = log.withColumn("starts", F.concat(F.array(F.lit(0)), F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1)))))
    log = log.select("conv_id", *(["place"] if place else []), "log", F.posexplode("starts").alias("opened", "start"), F.expr("size(starts)").alias("n"), "starts")
    log = log if place else log.withColumn("place", F.get("log", F.col("start"))["seq"])
    until = F.when(F.col("opened") + 1 < F.col("n"), F.get("starts", F.col("opened") + 1)).otherwise(F.size("log"))
    log = log.select("conv_id", "place", "opened", F.slice("log", F.col("start") + 1, until - F.col("start")).alias("log"))
    resets = F.transform("log", lambda x, i: F.when(x["kind"].isin(*RESETS), i))
    kept = F.slice("log", F.greatest(F.coalesce(F.array_max(resets), F.lit(0)), F.lit(0)) + 1, F.size("log"))
    text = F.array_join(F.transform(F.filter(kept, lambda x: x["kind"] != "regenerate"), lambda x: x["text"]), "")
    role = F.coalesce(F.get(F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    return log.select("conv_id", "place", "opened", role.alias("role"), text.alias("text"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.regexp_replace(escape(c), r"<(\\*)n>", r"<\\$1n>"), F.lit("\n"), F.lit("<n>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.regexp_replace(F.replace(c, F.lit("<n>"), F.lit("\n")), r"<\\(\\*)n>", "<$1n>"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans`` array<turn, turn_start, start, length> (code points)."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("place").asc_nulls_first(), "role", "text", "opened")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    m = messages.select("conv_id", "place", "role", "text", "opened", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("__head"), escape(F.col("text")).alias("__body"))
    m = m.withColumn("__piece", F.concat("__head", "__body", F.lit(END + "\n")))
    m = m.withColumn("__turn", F.row_number().over(by_turn)).withColumn("__at", F.coalesce(F.sum(F.length("__piece").cast("long")).over(before), F.lit(0).cast("long")))
    start = (F.col("__at") + F.length("__head")).alias("start")
    span = F.when(F.col("role") == trained, F.struct((F.col("__turn") - 1).alias("turn"), F.col("__at").alias("turn_start"), start, F.length("__body").cast("long").alias("length")))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("__turn", "__piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["__piece"]), "").alias("formatted"), "loss_spans")


def chat_format(events: DataFrame, trained: str = "assistant", message: tuple[str, ...] = ("message",), place: str | None = None) -> DataFrame:
    return render(fold(events, message, place), trained)


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text), formatted through its log."""
    return chat_format(events_of_turns(turns, trained=trained), trained, MESSAGE, "place")


def _pieces(formatted: Column) -> Column:
    """The text from each turn's start marker on, without the marker."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, unescaped."""
    return F.transform(_pieces(formatted), lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order; a span is cut from its own turn, so this is linear."""
    pieces = _pieces(formatted)
    cut = F.transform(spans, lambda s: unescape(F.substring(F.get(pieces, s["turn"]), (s["start"] - s["turn_start"] - len(START) + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
