"""Chat conversations as budgeted training windows, in DataFrame operations only.

A turn is written ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks). Control strings
inside texts get one backslash after their first character, or one more if they have some already, so that no text contains
a control string and the original comes back by taking one backslash away. Role names are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_TAILS = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _TAILS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _TAILS, r"$1$2$3")


def chat_windows(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 1024,
    history_turns: int = 2,
    history_budget: int = 256,
    target_role: str = "assistant",
) -> DataFrame:
    """Cut every conversation into turn-aligned windows of at most ``budget`` tokens.

    Tokens are words and punctuation marks, with four more per turn for its marks. Windows take new turns as long as
    the prefix sums allow. Each later window starts with the leading system turn, if there is one,
    and up to ``history_turns`` turns before its own, of at most ``history_budget`` tokens; the history is
    shortened, to nothing if need be, until it fits beside the system turn and the new one. A turn that with the system turn alone exceeds the budget is
    never cut: it gets a window of its own, the only kind above the budget. Every turn is new in exactly one window, and only new
    turns of ``target_role`` are under the loss mask.

    Returns ``conv_id``, ``window`` (from 0), ``formatted``, ``n_repeated`` (leading turns already
    seen in an earlier window), ``n_tokens`` and ``spans``: start and length, in code points, of the texts under the mask.

    Defined cases: turns are ordered by turn (nulls first), role, text; a null text or role is
    empty; rows with a null conversation are one conversation; repeated rows are
    turns like any other; other columns are left out, whatever their names; an empty table gives an empty result.
    A conversation is one unit of work: its turns must fit into one task.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.withColumns({"head": F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")), "body": escape(F.col("text")), "tokens": F.regexp_count("text", F.lit(_TOKEN)) + 4})
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + len(CLOSE))
    # A turn that repeats in full sits beside its copy; the number keeps their order fixed.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"at": F.row_number().over(order) - 1, "tokens_to": F.sum("tokens").over(upto), "chars_to": F.sum("chars").over(upto)})
    turn = F.struct("at", (F.col("role") == target_role).alias("target"), (F.col("role") == "system").alias("system"), "head", "body", "tokens", "chars", "tokens_to", "chars_to")
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))

    t = F.col("t")
    before = lambda i, what: t[i][f"{what}_to"] - t[i][what]
    system = t[0]["system"].cast("int")
    system_tokens = system * t[0]["tokens"]

    def history(start: Column) -> Column:
        """The first repeated turn of a window that starts there, so that system turn, history and new turn fit; the system turn is never among them."""
        span = F.sequence(F.greatest(start - history_turns, F.least(system, start)), start)
        short = lambda i: before(start, "tokens") - before(i, "tokens") <= history_budget
        fits = lambda i: system_tokens + t[start]["tokens_to"] - before(i, "tokens") <= budget
        return F.element_at(F.filter(span, lambda i: F.when(i == start, True).otherwise(short(i) & fits(i))), 1)

    def step(a: Column, x: Column) -> Column:
        """Open a window at the turn x that no longer fits the current one."""
        over = (x["at"] > a["start"]) & (x["tokens_to"] - a["base"] > budget)
        # base: tokens before what the window repeats, less the system turn that it puts in front.
        base = before(history(x["at"]), "tokens") - system_tokens
        return F.struct(
            F.when(over, x["at"]).otherwise(a["start"]).alias("start"),
            F.when(over, base).otherwise(a["base"]).alias("base"),
            F.when(over, F.concat(a["starts"], F.array(x["at"]))).otherwise(a["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("start"), F.lit(0).cast("long").alias("base"), F.array(F.lit(0)).alias("starts"))
    convs = convs.withColumn("starts", F.aggregate("t", zero, step, lambda a: a["starts"]))
    spans = convs.select("conv_id", "t", F.posexplode("starts").alias("window", "start"), F.concat(F.expr("slice(starts, 2, size(starts))"), F.array(F.size("t"))).alias("ends"))
    spans = spans.withColumn("end", F.col("ends")[F.col("window")]).withColumn("from", history(F.col("start")))
    front = system * (F.col("from") > 0).cast("int")
    shown = F.concat(F.slice("t", 1, front), F.slice("t", F.col("from") + 1, F.col("end") - F.col("from")))
    new = F.filter(F.slice("t", F.col("start") + 1, F.col("end") - F.col("start")), lambda x: x["target"])
    skip = front * t[0]["chars"] - before(F.col("from"), "chars")
    return spans.select(
        "conv_id",
        "window",
        F.array_join(F.transform(shown, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        (front + F.col("start") - F.col("from")).alias("n_repeated"),
        F.aggregate(shown, F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("n_tokens"),
        F.transform(new, lambda x: F.struct((skip + x["chars_to"] - x["chars"] + F.length(x["head"])).cast("int").alias("start"), F.length(x["body"]).alias("length"))).alias("spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The conversations that windows hold, read back from their text and masks.

    Returns ``conv_id``, ``turns`` (role, text; each once, in order), ``loss_text`` (everything under the
    masks, unescaped) and ``formatted_chars``.
    """
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    line = lambda p: F.instr(p, "\n")
    turn = lambda p: F.struct(
        F.url_decode(F.substring(p, F.lit(len(OPEN) + 1), line(p) - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, line(p) + 1, F.length(p))).alias("text")
    )
    under = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    per_window = windows.select("conv_id", F.struct("window", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    convs = per_window.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return convs.select(
        "conv_id",
        F.flatten("w.turns").alias("turns"),
        F.array_join("w.loss", "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("formatted_chars"),
    )
