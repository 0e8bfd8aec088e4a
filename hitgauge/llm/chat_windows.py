"""Chat formatting in budgeted windows (native).

A conversation becomes windows of whole turns. Running sums of turn tokens deal the turns to spans of
half a budget by where they start, so no state is carried from turn to turn; a span whose last turn
would break the budget gives that turn a window of its own. Every window begins with the system turn
(if the conversation opens with one), then repeats as many of the turns just before it as fit in a
quarter of the budget and in what its own turns leave, then holds its own turns. Only assistant texts
among its own turns are in the loss mask, so each is a target exactly once. A window exceeds the budget
only if one turn does together with the system turn, or if the system turn alone takes over half of it;
it is then marked ``over_budget``, never cut.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn. Control strings inside texts (those of
the template and the usual ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first
character; a string that already has backslashes there gets one more, so taking one away restores any
text. Roles have line breaks and percent signs in percent code as well.

Cases: a NULL text or role is empty; a NULL turn sorts first; equal turn numbers go by role, then text;
repeated rows are repeated turns; a NULL conversation id is a conversation of its own; no rows give no
windows; columns beyond the four named ones are not used.

Running sums are taken in two levels (blocks of turn numbers, then turns within a block), so a
conversation of any length is spread over tasks by block and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitgauge.staging import attach

#: The template, and what must not stand in a text as it is.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"(<|\[)(\\*)\\(\||/?s>|/?INST\])"

WORDS = r"[^\x20\x09-\x0D]+"
#: Tokens that the template adds to a turn; at least 1, so that every turn has a place of its own.
OVERHEAD = 4
#: Turn numbers in a block of running sums.
BLOCK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_role(role: Column) -> Column:
    return escape(_swap(role, ("%", "%25"), ("\n", "%0A")))


def unescape_role(role: Column) -> Column:
    return _swap(unescape(role), ("%0A", "\n"), ("%25", "%"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with tokens, ``start`` (tokens before them), ``total`` (of the conversation) and ``is_system``."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / BLOCK).alias("block"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(WORDS)) + OVERHEAD).cast("bigint"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("in_block"))
    order = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        "conv_id",
        "block",
        (F.sum("in_block").over(order) - F.col("in_block")).alias("before"),
        F.sum("in_block").over(Window.partitionBy("conv_id")).alias("total"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("tokens").over(inside) - F.col("tokens")
    return attach(rows, blocks, ["conv_id", "block"]).withColumn("start", start).withColumn(
        "is_system", (F.col("start") == 0) & (F.col("role") == "system")
    )


def format_windows(turns: DataFrame, budget: int = 512) -> DataFrame:
    """(conv_id, window, formatted, loss, repeated, tokens, over_budget), one row per window.

    ``loss`` lists the [start, end) code points of ``formatted`` that are targets, ``repeated`` is the
    number of turns at the front that an earlier window has already shown.
    """
    stride, history = max(1, budget // 2), max(1, budget // 4)
    span = F.floor(F.col("start") / stride).cast("bigint")
    placed = _placed(turns).withColumn("span", span).select(
        "conv_id",
        "span",
        F.floor(F.col("total") / stride).cast("bigint").alias("last_span"),
        F.struct(
            "start",
            "tokens",
            "is_system",
            F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body"),
            (F.col("role") == "assistant").alias("target"),
        ).alias("t"),
    )
    own = F.array(F.struct(F.col("span").alias("to"), F.lit(0).alias("kind")))
    none = F.slice(own, 1, 0)
    near = (~F.col("t.is_system")) & (F.col("t.start") >= (F.col("span") + 1) * stride - history)
    later = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.greatest("last_span", F.lit(1).cast("bigint"))),
        lambda x: F.struct(x.alias("to"), F.lit(1).alias("kind")),
    )
    copies = F.concat(
        own,
        F.when(near, F.array(F.struct((F.col("span") + 1).alias("to"), F.lit(1).alias("kind")))).otherwise(none),
        F.when(F.col("t.is_system"), later).otherwise(none),
    )
    dealt = placed.select("conv_id", "t", F.explode(copies).alias("c"))
    spans = dealt.groupBy("conv_id", F.col("c.to").alias("span")).agg(
        F.array_sort(F.collect_list(F.when(F.col("c.kind") == 0, F.col("t")))).alias("fresh"),
        F.array_sort(F.collect_list(F.when(F.col("c.kind") == 1, F.col("t")))).alias("prior"),
    )
    n = F.size("fresh")
    first, last = F.element_at("fresh", 1), F.element_at("fresh", -1)
    systems = F.filter("prior", lambda t: t["is_system"])
    in_system = F.coalesce(F.get(systems, F.lit(0))["tokens"], F.lit(0))
    spread = last["start"] + last["tokens"] - first["start"]
    whole = F.struct(F.lit(0).alias("sub"), F.col("fresh").alias("fresh"), F.col("prior").alias("prior"))
    body = F.slice("fresh", 1, F.greatest(n - 1, F.lit(0)))
    parts = F.array(
        F.struct(F.lit(0).alias("sub"), body.alias("fresh"), F.col("prior").alias("prior")),
        F.struct(F.lit(1).alias("sub"), F.slice("fresh", -1, 1).alias("fresh"), F.concat("prior", body).alias("prior")),
    )
    split = (n > 1) & (in_system + spread > budget)
    windows = spans.filter(n > 0).select(
        "conv_id", "span", F.explode(F.when(split, parts).otherwise(F.array(whole))).alias("w")
    ).select("conv_id", (F.col("span") * 2 + F.col("w.sub")).alias("window"), "w.fresh", "w.prior")
    windows = windows.select(
        "*",
        first["start"].alias("from"),
        (last["start"] + last["tokens"] - first["start"]).alias("new_tokens"),
        systems.alias("systems"),
        in_system.alias("in_system"),
    )
    room = F.least(F.lit(history), F.lit(budget) - F.col("in_system") - F.col("new_tokens"))
    windows = windows.withColumn("room", room)
    seen = F.filter("prior", lambda t: (~t["is_system"]) & (t["start"] >= F.col("from") - F.col("room")))
    windows = windows.withColumn("old", F.concat("systems", seen)).withColumn(
        "shown",
        F.concat(
            F.transform("old", lambda t: t.withField("target", F.lit(False))), F.col("fresh")
        ),
    )
    Acc = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss"))

    def add(acc: Column, t: Column) -> Column:
        start = (acc["at"] + F.char_length(t["head"])).cast("int")
        end = (start + F.char_length(t["body"])).cast("int")
        loss = F.when(
            t["target"], F.concat(acc["loss"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        ).otherwise(acc["loss"])
        return F.struct((end + len(CLOSE)).cast("int").alias("at"), loss.alias("loss"))

    tokens = F.aggregate("shown", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"])
    pieces = F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    return windows.select(
        "conv_id",
        "window",
        F.array_join(pieces, "").alias("formatted"),
        F.aggregate("shown", Acc, add, lambda a: a["loss"]).alias("loss"),
        F.size("old").alias("repeated"),
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window what its own turns say, read from the formatted text alone.

    (conv_id, window, turns array<struct<role,text>>, targets array<string>)
    """
    pieces = F.split("formatted", F.lit("<\\|im_end\\|>\n"), -1)
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def parse(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(rest, "\n", 1)
        text = F.substr(rest, F.char_length(role) + 2)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    def target(s: Column) -> Column:
        return unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))

    return windows.select(
        "conv_id",
        "window",
        F.transform(own, parse).alias("turns"),
        F.transform("loss", target).alias("targets"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
