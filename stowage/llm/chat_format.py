"""Chat formatting: budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: a window reaches as far
as the sum from its first turn stays in what the budget leaves for new turns. Each window after the first repeats the
system turn and the last turns before it, as far as a history budget and the room go, and only new assistant turns
are under the loss mask.

A turn's tokens are given in a column, or counted as the UTF-8 bytes of the turn as it is rendered: no byte-level
vocabulary makes more tokens of it. No window of several turns exceeds the budget. A turn that leaves no room for the
system turn is a window of its own, without it, and so is one that is longer than the budget.

The template marks turns with control strings. In roles and texts a backslash escapes backslashes and the bar
of `<|` (and line ends in roles), so that no control string can come from a text, and parse() gives back every
turn exactly.

Everything is DataFrame expressions. Turns are ranked within their conversation and worked on in segments of
`segment` ranks, so that a conversation of any length is many rows, however its turns are numbered; each segment gets
copies of the system turn and of the last `history_turns` turns of the segment before. A window ends with its segment.

Null roles and texts are empty, null turns come first; turns of one number go by role and text; repeated rows are
repeated turns; a null conv_id is a conversation like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.util import group_key, offsets, with_prefix_sums

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET, SYSTEM = "assistant", "system"
#: Turn numbers that are ranked together.
NUMBERS = 4096


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(turn: Column) -> Column:
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(END))


def _tokens(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + t["tokens"])


def ranked_turns(conversations: DataFrame, tokens: str | None) -> DataFrame:
    """conv_id, turn (role, text, tokens), rank from 0 by turn, role and text, and rows of each conversation's turns.

    Ranks are counts of the turn numbers below plus ranks among NUMBERS of them, so that no conversation is one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = F.struct(role.alias("role"), text.alias("text"))
    n = F.greatest(F.col(tokens).cast("long"), F.lit(0)) if tokens else F.octet_length(render(plain)).cast("long")
    turn = F.struct(role.alias("role"), text.alias("text"), F.coalesce(n, F.lit(0)).alias("tokens"))
    number = F.col("turn").cast("long")
    df = conversations.select("conv_id", number.alias("turn"), turn.alias("t"), group_key(F.col("conv_id")).alias("__c"), F.coalesce(F.floor(number / NUMBERS), F.lit(-(1 << 60))).cast("long").alias("__b"))
    counts = df.groupBy("__c", "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = offsets(counts, ["__c"], "__b", "__n").withColumn("rows", F.sum("__n").over(Window.partitionBy("__c"))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__c", "__b").orderBy("turn", "t.role", "t.text")).cast("long") - 1
    df = df.withColumn("__i", inside).join(starts, ["__c", "__b"])
    return df.select("conv_id", "t", (F.col("__before") + F.col("__i")).alias("rank"), "rows")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 512, history_turns: int = 8, segment: int = 256, tokens: str | None = None) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text; tokens: name of a column of token counts of rendered turns).

    Returns conv_id, segment and window (in order of both), formatted, loss_spans (start and end code points of
    texts under the mask), n_repeated (leading turns that earlier windows hold), n_turns (new ones).
    """
    segment = max(segment, history_turns + 1)
    df = ranked_turns(conversations, tokens)
    own, last = F.floor(F.col("rank") / segment), F.floor((F.col("rows") - 1) / segment)
    is_system = (F.col("rank") == 0) & (F.col("t.role") == SYSTEM)
    # 2: new turns of a segment, 1: the tail of the one before, 0: the system turn, in all segments
    copy = lambda s, kind: F.struct(s.cast("long").alias("segment"), F.lit(kind).alias("kind"))
    nothing = F.array().cast("array<struct<segment:bigint,kind:int>>")
    tail = F.when((F.col("rank") % segment >= segment - history_turns) & (own < last) & ~is_system, F.array(copy(own + 1, 1))).otherwise(nothing)
    system = F.when(is_system, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda s: copy(s, 0))).otherwise(nothing)
    df = df.withColumn("c", F.explode(F.concat(F.array(copy(own, 2)), tail, system)))
    df = df.groupBy("conv_id", F.col("c.segment").alias("segment")).agg(F.sort_array(F.collect_list(F.struct("c.kind", "rank", "t"))).alias("all"))
    of = lambda kind: F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: x["t"])
    df = df.select("conv_id", "segment", of(2).alias("turns"), of(1).alias("tail"), of(0).alias("system"))
    df = df.withColumn("leads", (F.col("segment") == 0) & (F.size("system") > 0))  # the first turn is the system turn itself
    df = df.withColumn("room", F.lit(budget - history) - _tokens(F.col("system"))).withColumn("lengths", F.transform("turns", lambda t: t["tokens"]))
    df = with_prefix_sums(df, "lengths", "starts")

    def head(heads: Column, i: Column) -> Column:
        """The first turn of the window of turn i: that of the turn before, if the sum since then has room for this one."""
        before = F.element_at(heads, -1)
        span = F.get("starts", i) + F.get("lengths", i) - F.get("starts", before)
        own_room = F.when(F.col("leads") & (before == 0), F.lit(budget - history)).otherwise(F.col("room"))
        return F.concat(heads, F.array(F.when(span <= own_room, before).otherwise(i)))

    df = df.withColumn("of", F.aggregate(F.slice(F.sequence(F.lit(0), F.size("turns") - 1), 2, F.size("turns")), F.array(F.lit(0)), head))
    df = df.select("conv_id", "segment", "turns", "tail", "system", "leads", "of", F.posexplode(F.array_distinct("of")).alias("window", "at"))
    df = df.withColumn("new", F.slice("turns", F.col("at") + 1, F.size(F.filter("of", lambda w: w == F.col("at")))))
    earlier = F.concat("tail", F.slice("turns", F.when(F.col("leads"), 2).otherwise(1), F.greatest(F.col("at") - F.col("leads").cast("int"), F.lit(0))))
    df = df.withColumn("before", F.slice(earlier, F.greatest(F.size(earlier) - history_turns + 1, F.lit(1)), history_turns))
    df = df.withColumn("shows", F.when(F.col("leads") & (F.col("at") == 0), F.slice("system", 1, 0)).otherwise(F.col("system")))
    df = df.withColumn("left", F.lit(budget) - _tokens(F.col("shows")) - _tokens(F.col("new")))
    suffix = F.filter("before", lambda t, i: _tokens(F.slice("before", i + 1, history_turns)) <= F.least(F.lit(history).cast("long"), F.col("left")))
    repeated = F.when(F.col("left") >= 0, F.concat("shows", suffix)).otherwise(F.slice("system", 1, 0))
    df = df.select("conv_id", "segment", "window", "new", repeated.alias("repeated"))
    df = df.withColumn("shown", F.concat("repeated", "new")).withColumn("parts", F.transform("shown", render))
    df = df.withColumn("lengths", F.transform("parts", lambda x: F.length(x).cast("long")))
    df = with_prefix_sums(df, "lengths", "starts")
    begins = lambda t: F.length(escape_role(t["role"])) + len(START) + 1
    spans = F.transform("shown", lambda t, i: F.struct((F.get("starts", i) + begins(t)).cast("long").alias("start"), (F.get("starts", i) + F.get("lengths", i) - len(END)).cast("long").alias("end"), ((i >= F.size("repeated")) & (t["role"] == TARGET)).alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return df.select("conv_id", "segment", "window", F.array_join("parts", "").alias("formatted"), loss.alias("loss_spans"), F.size("repeated").alias("n_repeated"), F.size("new").alias("n_turns"))


def parse(formatted: DataFrame) -> DataFrame:
    """windows()'s rows with turns: (role, text) of the new turns, and losses: texts under the mask, all read from the formatted text."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    df = formatted.withColumn("__p", F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated")))
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    role = lambda x: F.regexp_extract(x, head, 1)
    turns = F.transform(F.transform("__p", body), lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring(x, F.length(role(x)) + 2, F.length(x))).alias("text")))
    losses = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return df.withColumn("turns", turns).withColumn("losses", losses).drop("__p")


def digest(conversations: DataFrame, **parameters) -> DataFrame:
    """Per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is that of the whole conversation, whose text therefore meets in one row here, and here alone.
    """
    df = parse(windows(conversations, **parameters))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    df = df.select("conv_id", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"), F.struct("segment", "window", turns.alias("turns"), F.array_join("losses", "").alias("loss")).alias("w"))
    df = df.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("ws"))
    loss = F.array_join("ws.loss", "")
    return df.select("conv_id", "n_turns", F.sha2(F.array_join("ws.turns", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
