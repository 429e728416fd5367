"""Operator 4. Chat formatting in budgeted windows, with Spark SQL functions only.

Prefix sums of turn tokens cut a conversation at multiples of the room that a window has for
new turns. Turns that lie within one such cell form a window; a turn that crosses its end
joins them if the window still holds it, else it has a window of its own (over the budget
only if it is by itself). Every later window repeats the system turn and, as far as they
fit, the last turns before it; the loss mask spans assistant turns in the window where they
are new, so each is a target once.

Template: `<|` role newline text `|>` newline for each turn, where the text's backslash, <
and > are written as backslash followed by `b`, `l` or `g`; a role's newline is `n`. So no
text can contain a mark, and unescape() gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.shared import pick

BUDGET = 1024
HISTORY_TOKENS = 192
HISTORY_TURNS = 2
CHARS_PER_TOKEN = 4

OPEN, CLOSE = "<|", "|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(text), F.lit(CLOSE))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokens: str | None = None) -> DataFrame:
    """One row per window of (conv_id, turn, role, text): conv_id, window (1, 2, ..),
    formatted, repeated (how many turns at its start were seen before), loss_spans
    (array of start, length in code points of formatted, from 0), tokens, over_budget.

    `tokens` names a column with the tokens of each turn as formatted, counted by the model's
    own tokenizer; the budget is kept in those, a turn costing 1 at least. Without it, and where
    it is null, they are estimated as the turn's formatted characters by four, rounded up, which is too few for text without spaces. The system
    turn is the conversation's first turn if its role is system. Null texts and roles are
    empty. Turns stand by turn (null first), then role and text, so that ties and repeated
    rows keep a fixed order; all are kept. A null conv_id is a conversation like others. An
    empty table gives no windows; further columns are ignored.

    Turns of a conversation meet in a window function, which streams over spilled rows and
    holds a few turns at a time; only a single window's texts are gathered into a row."""
    t = pick(turns, "conv_id", "turn", "role", "text", *([tokens] if tokens else []))
    # greatest() would pass over a null.
    counted = F.when(F.col(tokens).isNotNull(), F.greatest(F.col(tokens).cast("long"), F.lit(1))) if tokens else F.lit(None).cast("long")
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), counted.alias("counted"))
    t = t.withColumn("mark", _turn(F.col("role"), F.col("text"))).withColumn("tokens", F.coalesce("counted", F.ceil(F.length("mark") / CHARS_PER_TOKEN))).drop("counted")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_system = F.lower("role") == "system"
    t = (
        t.withColumn("at", F.row_number().over(w))
        .withColumn("end", F.sum("tokens").over(running))
        .withColumn("system", F.first(F.when(is_system, F.struct("mark", "tokens"))).over(running))
    )
    t = t.withColumn("sys_tokens", F.coalesce("system.tokens", F.lit(0)))
    for k in range(history_turns, 0, -1):
        t = t.withColumn(f"back{k}", F.lag(F.struct("mark", "tokens", "at"), k).over(w))
    # Cells leave room for the system turn and the history; one token at least, should those fill the budget.
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.col("sys_tokens"))
    start = F.col("end") - F.col("tokens")
    t = t.withColumn("cell", F.floor(start / room)).withColumn("crosses", F.col("end") > (F.col("cell") + 1) * room)
    # In a cell only its last turn can cross. first_start: of the cell's first turn, which precedes it.
    cell = Window.partitionBy("conv_id", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("first_start", F.first(start).over(cell))
    alone = F.col("crosses") & (F.col("end") - F.col("first_start") > room)
    t = t.withColumn("alone", alone & (start > F.col("first_start")))
    lead = F.when(F.col("alone") | (start == F.col("first_start")), F.array(*[F.col(f"back{k}") for k in range(history_turns, 0, -1)]))
    t = t.withColumn("before", lead)
    window = t.groupBy("conv_id", "cell", "alone").agg(
        F.min("at").alias("first_at"),
        F.sum("tokens").alias("new_tokens"),
        F.max("sys_tokens").alias("sys_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "mark", (F.lower("role") == "assistant").alias("target"), F.length(F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))).alias("role_length")))).alias("turns"),
        F.first("before", ignorenulls=True).alias("before"),
        F.first("system", ignorenulls=True).alias("system"),
    )
    has_system = F.col("system").isNotNull() & (F.col("first_at") > 1)
    sys_tokens = F.when(has_system, F.col("sys_tokens")).otherwise(0)
    left = F.least(F.lit(history_tokens), F.lit(budget) - F.col("new_tokens") - sys_tokens)
    # Nearest turns first: a turn is repeated if it and all nearer ones fit; the system turn is not repeated twice.
    history, used, fits = [], F.lit(0), F.lit(True)
    for k in range(1, history_turns + 1):
        one = F.element_at("before", history_turns + 1 - k)
        fits = fits & one.isNotNull() & ~(has_system & (one["at"] == 1)) & (used + one["tokens"] <= left)
        history.insert(0, F.when(fits, one["mark"]))
        used = used + F.when(fits, one["tokens"]).otherwise(0)
    seen = F.array_compact(F.array(F.when(has_system, F.col("system.mark")), *history))
    window = window.withColumn("seen", seen).withColumn("tokens", F.col("new_tokens") + sys_tokens + used)
    window = window.withColumn("prefix", F.array_join("seen", "")).withColumn("lengths", F.transform("turns", lambda x: F.length(x["mark"])))
    n = F.length("prefix")
    ends = F.aggregate(
        F.col("turns"),
        F.struct(n.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["mark"])).alias("at"),
            F.when(
                x["target"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(OPEN) + x["role_length"] + 1).cast("int").alias("start"), (F.length(x["mark"]) - (len(OPEN) + x["role_length"] + 1 + len(CLOSE))).cast("int").alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return window.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("first_at")).alias("window"),
        F.concat("prefix", F.array_join(F.transform("turns", lambda x: x["mark"]), "")).alias("formatted"),
        F.size("seen").alias("repeated"),
        ends["spans"].alias("loss_spans"),
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: n_turns, turns_sha256 (role,
    newline, text, newline of each turn), loss_chars and loss_sha256 (all text under the
    mask, unescaped), formatted_chars. A digest covers a whole conversation, so its new
    texts are gathered per conversation here, and only here."""
    pieces = F.split("formatted", r"\|>\n")
    new = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("repeated")))
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)
    text = lambda p: F.substr(p, F.instr(p, F.lit("\n")) + 1)
    read = windows.select(
        "conv_id",
        "window",
        F.size(new).alias("n"),
        F.array_join(F.transform(new, lambda p: F.concat(unescape(role(p)), F.lit("\n"), unescape(text(p)), F.lit("\n"))), "").alias("body"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "").alias("loss"),
        F.length("formatted").alias("chars"),
    )
    joined = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "body", "loss"))).alias("all"))
    return whole.select("conv_id", "n_turns", F.sha2(joined("body"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")
