"""Chat formatting in budgeted windows, with Spark expressions only.

*Template.* A turn is ``<s>[role]`` + text + ``</s>``. In roles and texts the characters
``\\ < [ ]`` are written ``\\e \\l \\b \\r``, so no control string can stand inside one,
and the original comes back by the reverse replacements.

*Windows.* Turns are counted in tokens. A conversation that fits the budget whole is one
window. Of others the prefix sums are laid on a grid of as many tokens as a window has left
beside this conversation's system turns and the history. Turns inside one grid cell make a
span; a turn across a border makes a span of its own. So every span holds whole turns and
fits the budget, and each turn is new in exactly one window. Turns are never cut: a window
that a very long turn or system turn makes longer than the budget is marked ``oversize``. A window shows the conversation's system turns
first, then the last turns before its span as history, as far as ``history`` tokens reach,
then the span. Only assistant turns that are new in the window are under the loss mask;
repeated ones are masked out.

The prefix sums are taken in two steps: inside the parts that a range partitioning makes
of the rows, which split a conversation of any length, and over the sums of the parts.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first),
then role and text, so repeated rows follow one another; a null conversation id is one
conversation; very long turns are kept whole; other columns, whatever their names, are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawharbor.llm.common import WORD, encoded, materialize, quoted
from rawharbor.operators.joins import join_reduced

BUDGET = 1024  # tokens of a window
HISTORY = 256  # of which at most so many are repeated turns
SYSTEM = 256  # system turns that have more tokens than this make windows longer
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    """The reverse order: the escape of the escape sign is undone last."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>["), escaped(role), F.lit("]"), escaped(text), F.lit("</s>"))


def tokens(text: Column) -> Column:
    """Words of a turn, and two for its marks."""
    return (F.regexp_count(text, F.lit(WORD)) + 2).cast("bigint")


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv, part, place, role, text, tokens, before, ordinal``: turns in order with the
    tokens and turns before each in its conversation, system turns not counted."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = conversations.select(
        quoted(conv_id).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("cost", tokens(F.col("text"))).withColumn("tokens", F.when(F.col("role") == "system", 0).otherwise(F.col("cost")).cast("bigint"))
    # Parts must stay what they are when a task is repeated: written, then read.
    spread = F.rand(11)
    parted = materialize(
        rows.withColumn("spread", spread).repartitionByRange("conv", *order, "spread").drop("spread").withColumn("part", F.spark_partition_id()),
        "turns",
    )
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn("inside", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).withColumn(
        "row", F.row_number().over(inside) - 1
    )
    parts = parted.groupBy("conv", "part").agg(F.sum("tokens").alias("held"), F.count("*").alias("rows"))
    previous = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.xxhash64("conv", "part").alias("at"),
        F.col("conv").alias("c_conv"),
        F.col("part").alias("c_part"),
        F.coalesce(F.sum("held").over(previous), F.lit(0)).alias("offset"),
        F.coalesce(F.sum("rows").over(previous), F.lit(0)).alias("row_offset"),
    )
    same = (F.col("part") == F.col("c_part")) & F.col("conv").eqNullSafe(F.col("c_conv"))
    return local.join(carried, same).select(
        "conv",
        "role",
        "text",
        "cost",
        "tokens",
        (F.col("inside") + F.col("offset")).alias("before"),
        (F.col("row") + F.col("row_offset")).cast("bigint").alias("ordinal"),
    )


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, conv_id: str = "conv_id"
) -> DataFrame:
    """``conv_id, window, formatted, segments, oversize``, one row per window.

    ``segments`` has, for each turn of the window in order: ``ordinal`` of the turn,
    ``start`` and ``end`` of its escaped text in ``formatted`` (code points), ``kind``
    (``system``, ``history`` or ``new``) and ``loss``.
    """
    if budget <= history + system:
        raise ValueError("the budget leaves no room for new turns")
    least, room = budget - history - system, F.col("room")
    numbered = materialize(numbered_turns(conversations, conv_id), "numbered")
    spoken = F.when(F.col("role") == "system", F.col("cost")).otherwise(0)
    sums = numbered.groupBy("conv").agg(F.sum("tokens").alias("total"), F.sum(spoken).alias("system_tokens"))
    whole = F.col("total") + F.col("system_tokens") <= budget
    rooms = sums.select(
        encoded(F.col("conv")).alias("conv_key"),
        F.when(whole, F.greatest("total", F.lit(1)))
        .otherwise(F.greatest(budget - history - F.col("system_tokens"), F.lit(least)))
        .cast("bigint")
        .alias("room"),
    )
    turns = join_reduced(numbered.withColumn("conv_key", encoded(F.col("conv"))), rooms, ["conv_key"], "inner").drop("conv_key")
    cell = F.floor(F.col("before") / room)
    last = F.floor((F.col("before") + F.col("tokens") - 1) / room)
    # Even numbers for the turns inside a cell, odd ones for a turn across its end.
    placed = turns.withColumn(
        "window", F.when(F.col("tokens") == 0, F.lit(None)).otherwise(2 * cell + (last > cell).cast("bigint"))
    )
    plain = placed.filter("role <> 'system'")
    spans = plain.groupBy("conv", "window").agg(F.min("before").alias("from_tokens"), F.first("room").alias("room"))
    # History: the turns that end within ``history`` tokens before a span. They can only lie
    # in cells near it, so turns and spans meet by cell.
    reach = F.sequence(F.floor((F.col("from_tokens") - history) / room), F.floor(F.col("from_tokens") / room))
    seekers = spans.select(F.col("conv").alias("s_conv"), F.col("window").alias("s_window"), "from_tokens", F.explode(reach).alias("s_cell"))
    near = plain.withColumn("end_cell", F.floor((F.col("before") + F.col("tokens")) / room))
    repeats = near.join(
        seekers,
        near["conv"].eqNullSafe(seekers["s_conv"])
        & (near["end_cell"] == seekers["s_cell"])
        & (near["before"] >= seekers["from_tokens"] - history)
        & (near["before"] + near["tokens"] <= seekers["from_tokens"]),
    ).select("conv", F.col("s_window").alias("window"), "role", "text", "cost", "ordinal", F.lit("history").alias("kind"))
    new = plain.select("conv", "window", "role", "text", "cost", "ordinal", F.lit("new").alias("kind"))
    # System turns go to every window; a conversation of system turns alone has one window.
    heads = placed.filter("role = 'system'").select("conv", "role", "text", "cost", "ordinal")
    h = heads.select(F.col("conv").alias("h_conv"), "role", "text", "cost", "ordinal")
    s = spans.select("conv", "window")
    retained = h.join(s, h["h_conv"].eqNullSafe(s["conv"]), "left").select(
        F.col("h_conv").alias("conv"), F.coalesce("window", F.lit(0)).alias("window"), "role", "text", "cost", "ordinal", F.lit("system").alias("kind")
    )
    rank = F.when(F.col("kind") == "system", 0).when(F.col("kind") == "history", 1).otherwise(2)
    shown = retained.unionByName(repeats).unionByName(new).select(
        "conv", "window", F.struct(rank.alias("rank"), "ordinal", "kind", "role", rendered(F.col("role"), F.col("text")).alias("turn")).alias("t"),
        "cost",
    )
    gathered = shown.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.sum("cost").alias("cost")
    )
    lengths = F.transform("ts", lambda t: F.length(t["turn"]))
    ends = F.aggregate(
        lengths,
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    return (
        gathered.withColumn("ends", ends)
        .select(
            F.col("conv").alias("conv_id"),
            "window",
            F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"),
            F.transform(
                "ts",
                lambda t, i: F.struct(
                    t["ordinal"].alias("ordinal"),
                    (F.element_at("ends", i + 1) - F.length(t["turn"]) + F.length(escaped(t["role"])) + 5).alias("start"),
                    (F.element_at("ends", i + 1) - 4).alias("end"),
                    t["kind"].alias("kind"),
                    ((t["kind"] == "new") & (t["role"] == "assistant")).alias("loss"),
                ),
            ).alias("segments"),
            (F.col("cost") > budget).alias("oversize"),
        )
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Turns back from windows: ``conv_id, ordinal, role, text, loss``, each once."""
    windowed = formatted.withColumn("window_turns", F.split("formatted", "</s>"))
    turns = windowed.select(
        "conv_id", "window", F.posexplode("segments").alias("at", "segment"), "window_turns"
    ).select(
        "conv_id",
        "window",
        "segment.ordinal",
        "segment.kind",
        "segment.loss",
        F.element_at("window_turns", F.col("at") + 1).alias("turn"),
    )
    head = F.regexp_extract("turn", r"^<s>\[([^\]]*)\]", 1)
    fresh = turns.filter("kind = 'new'").select(
        "conv_id", "ordinal", head.alias("role"), F.expr("substring(turn, instr(turn, ']') + 1)").alias("text"), "loss"
    )
    # A system turn stands in every window and counts once.
    system = (
        turns.filter("kind = 'system'")
        .groupBy("conv_id", "ordinal")
        .agg(F.first("turn").alias("turn"))
        .select("conv_id", "ordinal", head.alias("role"), F.expr("substring(turn, instr(turn, ']') + 1)").alias("text"), F.lit(False).alias("loss"))
    )
    both = fresh.unionByName(system)
    return both.withColumns({"role": unescaped(F.col("role")), "text": unescaped(F.col("text"))})


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from them."""
    turns = read_turns(formatted).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "role", "text", "loss"))).alias("ts")
    )
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: t["text"]), "")
    sizes = formatted.groupBy(F.col("conv_id").alias("f_conv")).agg(F.sum(F.length("formatted").cast("bigint")).alias("formatted_chars"))
    per = turns.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
    )
    return per.join(sizes, per["conv_id"].eqNullSafe(sizes["f_conv"])).drop("f_conv")
