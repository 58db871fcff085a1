"""Chat formatting: conversations as training windows of a bounded size with a mask over what is learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"


def escape(text: Column | str) -> Column:
    """Breaks control strings: a backslash goes into each ([\\INST], <\\/s>), one before every backslash."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    broken = F.regexp_replace(doubled, r"\[(?=/?INST\])", r"[\\")
    return F.regexp_replace(broken, r"<(?=/?s>)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_tokens(text: Column) -> Column:
    """An estimate a tokenizer is not needed for: a token for four bytes, and four for the marks of a turn."""
    return F.ceil(F.octet_length(text) / 4) + 4


def windows(
    turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 4,
    tokens=turn_tokens,
) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, spans): conversations cut into windows of whole turns.

    Running sums of turn tokens choose the cuts: a turn belongs to the window its end falls into,
    where a window's stretch is what the budget leaves beside the system turn and the history, less
    the conversation's longest turn, so that a window never exceeds ``budget`` unless a single turn
    does. Every window begins with the conversation's system turn and repeats up to
    ``history_turns`` turns before its first one, of ``history`` tokens together. ``spans`` are the
    (start, length) of the loss mask in ``formatted``: the texts of assistant turns that are new in
    this window. ``n_repeated`` counts the turns before the new ones.

    Rows of a conversation are ordered by turn, then role and text, so repeated rows and ties stay
    in a fixed place; null texts and roles are empty; a null conversation or turn number is a
    value of its own that comes first; an empty table gives none. Other columns are ignored.
    """
    clean = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
    )
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = clean.select(
        "*", F.row_number().over(order).cast("long").alias("at"),
        # What is counted is what is written: role and text with their control strings escaped.
        tokens(F.concat(escape("role"), escape("text"))).cast("long").alias("size"),
    )
    first_system = (F.col("at") == 1) & (F.col("role") == "system")
    summed = sized.select(
        "*", F.sum("size").over(upto).alias("upto"), F.max("size").over(whole).alias("longest"),
        F.max(F.when(first_system, F.col("size"))).over(whole).alias("system_size"),
        F.max(F.when(first_system, F.col("text"))).over(whole).alias("system_text"),
    )
    room = F.lit(budget - history) - F.coalesce("system_size", F.lit(0))
    stretch = F.greatest(room - F.col("longest"), F.lit(1))
    cut = summed.withColumn("window", F.floor((F.col("upto") - 1) / stretch).cast("long"))
    follows = cut.select(
        "*", F.lag("window").over(order).alias("prev"),
        *[F.lead("window", d).over(order).alias(f"w{d}") for d in range(1, history_turns + 1)],
        *[F.lead("upto", d).over(order).alias(f"u{d}") for d in range(1, history_turns + 1)],
        *[F.lead("size", d).over(order).alias(f"s{d}") for d in range(1, history_turns + 1)],
    )
    piece = lambda window, rank, role, text, new: F.struct(
        window.alias("window"), rank.alias("rank"), role.alias("role"), text.alias("text"), new.alias("new")
    )
    role, text, at, window = (F.col(c) for c in ("role", "text", "at", "window"))
    copies = [piece(window, at, role, text, F.lit(True))]
    # Where a window begins that is not the first: its copy of the system turn.
    starts = (F.col("prev") != window) & F.col("system_text").isNotNull()
    copies.append(F.when(starts, piece(window, F.lit(0).cast("long"), F.lit("system"), F.col("system_text"), F.lit(False))))
    for d in range(1, history_turns + 1):
        before = window if d == 1 else F.col(f"w{d - 1}")
        begins = F.col(f"w{d}") != before
        near = F.col(f"u{d}") - F.col(f"s{d}") - (F.col("upto") - F.col("size")) <= history
        copies.append(F.when(begins & near & ~first_system, piece(F.col(f"w{d}"), at, role, text, F.lit(False))))
    placed = follows.select("conv_id", F.explode(F.filter(F.array(*copies), lambda p: p.isNotNull())).alias("p"))
    marked = placed.select(
        "conv_id", F.col("p.window").alias("window"),
        F.struct(
            F.col("p.new").alias("new"), F.col("p.rank").alias("rank"),
            F.concat(F.lit(OPEN), escape(F.col("p.role")), F.lit(CLOSE)).alias("head"), escape(F.col("p.text")).alias("body"),
            (F.col("p.new") & (F.col("p.role") == "assistant")).alias("learned"),
        ).alias("piece"),
    )
    grouped = marked.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END)
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + size(p)).alias("at"),
            F.when(p["learned"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).cast("long").alias("length")
            )))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("pieces", lambda p: ~p["new"])).alias("n_repeated"), spans.alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the new turns (role, text) and the texts under the mask, parsed from the output."""
    parts = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    new = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - F.col("n_repeated"), F.lit(0)))
    mark = rf"(?s)^\[INST\] (.*?) \[/INST\](.*)$"
    turns = F.transform(
        new,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, mark, 1)).alias("role"), unescape(F.regexp_extract(p, mark, 2)).alias("text")
        ),
    )
    learned = F.transform(
        "spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select("*", turns.alias("turns"), learned.alias("learned"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, from its windows in order; all values are read from the formatted text."""
    back = read_back(formatted)
    per_window = back.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("learned", "").alias("learned"),
        ).alias("w"),
        F.size("turns").cast("long").alias("n"), F.char_length("formatted").cast("long").alias("chars"),
    )
    return per_window.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars")
    ).select(
        "conv_id", "n_turns", F.sha2(F.array_join("ws.said", ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join("ws.learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("ws.learned", ""), 256).alias("loss_sha256"), "formatted_chars",
    )
