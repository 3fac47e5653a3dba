r"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` (starts a turn), ``delta`` (adds text), ``edit``
(replaces the text so far) and ``regenerate`` (drops it; its own text starts anew). Events are
partitioned by conversation and message, sorted by sequence number and folded into final turns: of each turn
the texts from its last message, edit or regenerate on, in order. Turns are rendered where they were folded
and only rendered turns meet by conversation, so a very long conversation is folded by many tasks.
All steps are DataFrame expressions.

The template puts ``<|start|>role<|text|>text<|end|>`` for a turn. Inside roles and texts a backslash
is doubled and one is put after the first character of each control string (also those of other common
templates: ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>``), so none of them stands in a rendered text;
``unescape`` gives the text back exactly. Assistant turns are under the loss mask.

Null texts and roles are empty; null conversations form one; equal sequence numbers are ordered by
message, kind, role and text; repeated ``message`` rows are turns of their own; a delta, edit or regenerate without
a message starts one. An empty log gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|text|>", "<|end|>"
#: First character and rest of control strings, as a regular expression.
CONTROL = r"([<\[])(\||/?s>|/?INST\]|/?<?/?SYS>>)"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of final turns as a log of ``message`` events; the turn's number is its message."""
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("seq"), F.col(turn).cast("string").alias("message_id"), F.lit("message").alias("kind"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final turns: conv_id, seq (of the turn's first event), message_id, nth (turn of its message), role, text."""
    rows = events.select("conv_id", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("message_id", F.lit("")).alias("message_id"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = F.array_position(F.array(*[F.lit(k) for k in ("message", "regenerate", "edit", "delta")]), F.col("kind"))
    group = Window.partitionBy("conv_id", "message_id")
    order = group.orderBy("seq", kinds, "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = rows.withColumn("nth", F.greatest(F.sum(one(F.col("kind") == "message")).over(order), F.lit(1)))
    rows = rows.withColumn("reset", F.sum(one(F.col("kind") != "delta")).over(order)).withColumn("at", F.row_number().over(order))
    turn = Window.partitionBy("conv_id", "message_id", "nth")
    rows = rows.withColumn("last", F.max("reset").over(turn))
    live = F.when(F.col("reset") == F.col("last"), F.struct("at", "text"))
    got = rows.groupBy("conv_id", "message_id", "nth").agg(F.min("seq").alias("seq"), F.min_by("role", F.when(F.col("role") != "", F.col("at"))).alias("role"), F.array_sort(F.collect_list(live)).alias("live"))
    return got.select("conv_id", "seq", "message_id", "nth", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("live.text"), "").alias("text"))


def render(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask (a flag a turn) and loss_spans (code points of ``formatted``, end exclusive)."""
    parts = turns.select("conv_id", F.struct("seq", F.expr("try_cast(message_id as bigint)").alias("n"), "message_id", "role", "nth", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), escape(F.col("text")), F.lit(END)).alias("piece"), F.col("role").isin(*loss_roles).alias("loss")).alias("t"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    made = whole.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), F.col("t.loss").alias("loss_mask"), "t")
    ends = running_sum(F.transform("t", lambda t: F.char_length(t["piece"])))
    # ``ends`` is an argument of zip_with: inside the lambda it would be computed anew for each turn
    spans = F.zip_with("t", ends, lambda t, e: F.when(t["loss"], F.struct((e - F.char_length(F.substring_index(t["piece"], SEP, -1))).cast("int").alias("start"), (e - len(END)).cast("int").alias("end"))))
    return made.select("conv_id", "formatted", "loss_mask", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def running_sum(numbers: Column) -> Column:
    """Inclusive running sums of an array in log2(size) passes (each adds what stands 1, 2, 4 ... before)."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(26)]), lambda s: s < F.size(numbers))
    return F.aggregate(steps, F.transform(numbers, lambda x: x.cast("long")), lambda acc, s: F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= s, F.get(acc, i - s)), F.lit(0))))


def parse(formatted: Column, mask: Column) -> Column:
    """Turns read back from a rendered conversation: array of (role, text, loss), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|start\|>", -1), 2, F.size(mask))

    def turn(p: Column, m: Column) -> Column:
        body = F.substring_index(p, END, 1)
        return F.struct(unescape(F.substring_index(body, SEP, 1)).alias("role"), unescape(F.substring_index(body, SEP, -1)).alias("text"), m.alias("loss"))

    return F.zip_with(pieces, mask, turn)


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Log of events to rendered conversations: conv_id, formatted, loss_mask, loss_spans."""
    return render(fold(events), loss_roles)
