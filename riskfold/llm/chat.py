r"""Chat formatting in budgeted windows.

What the system turn costs comes off the budget first; history and span share the rest. The
prefix sums of turn tokens cut a conversation: turns that lie whole between two multiples
of the span's share form one span, a turn that crosses a multiple is a span of its own. So
spans are turn-aligned, need no walk from turn to turn, and hold no more than the share,
save a single turn that is longer. A window is the system turn, as many turns before the
span as fit the history share and what the span leaves, and the span; it is above budget only
where a turn alone is longer than what the system turn leaves. Every turn is new in one
window; only new assistant turns are under the loss mask, so repeated targets are masked.

The template is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. In
texts and roles each backslash is doubled, ``<|`` becomes ``<\|`` and, in roles, a line feed
becomes ``\n``; so no control string can come from a text, and :func:`parsed` gives back the
turns. Masks are spans of characters of the formatted window.

Null texts and roles count as empty. Turns are ordered by number (nulls first), then role and
text; equal rows stay, and so do turns with equal or no numbers. Rows without a conversation id are
one conversation. The prefix sums of a long conversation are taken chunk by chunk; turns
with one number or none are one chunk. An empty table has no windows. Extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, SHARES = 512, (1, 2)  # tokens of a window; parts of history and span beside the system turn
MARK_TOKENS = 4
CHUNK = 1024


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column) -> Column:
    """Doubled backslashes split the text; what is left of backslashes stands for one character."""

    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def word_tokens(text: Column) -> Column:
    """Default cost of a text: its words."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1))


def _prefix(turns: DataFrame) -> DataFrame:
    """Adds ``before``, tokens of earlier turns of the conversation, ``nth`` of the turn, and
    ``lead``, tokens of the system turn that the conversation begins with, if any.

    Chunks of turn numbers are summed first, so that a conversation with most of the rows is
    not one group; within a chunk and over the chunks windows count on.
    """
    turns = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    counted = turns.withColumn("nth", F.row_number().over(inside) - 1).withColumn(
        "before", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0), F.struct("turn", "role", "text"))
    sums = turns.groupBy("conv", "chunk").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), first.alias("first")
    )
    chunks = Window.partitionBy("conv").orderBy("chunk")
    sums = sums.select(
        F.col("conv").alias("c_conv"),
        F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.first("first").over(chunks).alias("lead"),
    )
    same = F.col("conv").eqNullSafe(F.col("c_conv")) & F.col("chunk").eqNullSafe(F.col("c_chunk"))
    both = counted.join(sums, same)
    return both.withColumns(
        {
            "before": F.coalesce("before", F.lit(0)) + F.col("t0"),
            "nth": F.col("nth") + F.col("n0"),
        }
    ).drop("c_conv", "c_chunk", "t0", "n0")


def windows(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    shares: tuple[float, float] = SHARES,
    tokens=word_tokens,
) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, loss, n_repeated, n_new``.

    ``loss`` holds the start and end of each new assistant text. The first ``n_repeated``
    turns stand in an earlier window as well. Windows of a conversation go by ``window``.
    ``tokens`` gives the cost of a text; marks and role cost ``MARK_TOKENS``.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = _prefix(turns.withColumn("tokens", tokens(F.col("text")).cast("long") + MARK_TOKENS))
    left = F.greatest(F.lit(budget) - F.col("lead"), F.lit(1))
    turns = turns.withColumn("left", left)
    turns = turns.withColumn("history", F.floor(F.col("left") * (shares[0] / sum(shares))))
    turns = turns.withColumn("share", F.greatest(F.col("left") - F.col("history"), F.lit(1)))
    history, share = F.col("history"), F.col("share")
    cell, last = (F.floor(x / share) for x in (F.col("before"), F.col("before") + F.col("tokens") - 1))
    turns = turns.withColumn("span", 2 * cell + (cell != last).cast("long"))
    turns = turns.withColumn("system", (F.col("nth") == 0) & (F.col("role") == "system"))
    item = F.struct("nth", F.lit(True).alias("new"), "role", "text")
    own = turns.select("conv", "span", item.alias("item"))
    spans = turns.groupBy("conv", "span").agg(
        F.min("before").alias("start"),
        F.max("system").alias("has"),
        F.least(F.max("history"), F.max("left") - F.sum("tokens")).alias("room"),
    )
    spans = spans.select(F.col("conv").alias("s_conv"), F.col("span").alias("s_span"), "start", "has", "room")
    again = F.struct("nth", F.lit(False).alias("new"), "role", "text").alias("item")
    # Spans that may start within the history share after a turn; few, as spans fill cells.
    ahead = F.sequence(2 * cell, 2 * F.floor((F.col("before") + history) / share) + 1)
    earlier = turns.filter("not system").withColumn("to", F.explode(ahead)).filter("to > span")
    met = F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("to") == F.col("s_span"))
    past = earlier.join(spans, met).filter(F.col("start") - F.col("before") <= F.col("room"))
    heads = turns.filter("system").join(
        spans.filter("not has"), F.col("conv").eqNullSafe(F.col("s_conv"))
    )
    every = own.unionByName(past.select("conv", F.col("to").alias("span"), again)).unionByName(
        heads.select("conv", F.col("s_span").alias("span"), again)
    )
    grouped = every.groupBy("conv", "span").agg(F.sort_array(F.collect_list("item")).alias("items"))
    formed = grouped.withColumn("made", F.transform("items", _formed))
    return formed.select(
        F.col("conv").alias("conv_id"),
        F.col("span").alias("window"),
        F.array_join(F.transform("made", lambda m: F.concat(m["head"], m["body"], m["tail"])), "").alias(
            "formatted"
        ),
        _loss(F.col("made")).alias("loss"),
        F.size(F.filter("items", lambda x: ~x["new"])).alias("n_repeated"),
        F.size(F.filter("items", lambda x: x["new"])).alias("n_new"),
    )


def _formed(item: Column) -> Column:
    head = F.concat(F.lit(START), escaped(item["role"], role=True), F.lit("\n"))
    return F.struct(
        head.alias("head"),
        escaped(item["text"]).alias("body"),
        F.lit(END + "\n").alias("tail"),
        (item["new"] & (item["role"] == "assistant")).alias("target"),
    )


def _loss(made: Column) -> Column:
    """Character spans of the targets: turns' lengths are added up from the front."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(m["target"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + F.length(m["tail"])).alias("at"), spans.alias("spans"))

    return F.aggregate(made, begin, step, lambda s: s["spans"])


def parsed(formatted: Column) -> Column:
    """Turns of a formatted window as an array of ``role`` and ``text``."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        role = F.substring(line, F.lit(len(START) + 1), F.length(line))
        text = F.substring(piece, F.length(line) + 2, F.length(piece))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(turns, turn)


def targets(formatted: Column, loss: Column) -> Column:
    """Texts under the mask, as they were."""
    return F.transform(
        loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    )


def read_back(formed: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: digests of all turns and of all text under the mask."""
    new = F.filter(parsed(F.col("formatted")), lambda _, i: i >= F.col("n_repeated"))
    each = formed.select(
        "conv_id",
        "window",
        "n_new",
        F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(targets(F.col("formatted"), F.col("loss")), "").alias("targets"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n_new").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
    )
    told, learnt = (F.array_join(F.col("w")[x], "") for x in ("turns", "targets"))
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )
