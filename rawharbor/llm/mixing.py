"""Mixing sources to target weights with a bound on how often a source may repeat.

*Water filling.* A source asks for its weight's share of the budget. Sources whose
share exceeds ``max_epochs`` times their size are clamped there, and what they leave is
dealt out to the others by weight until nobody is above. With the level L solving
sum(min(cap, L * weight)) = budget this is one sorted pass: sources by cap / weight,
running sums of caps and weights.

*Repetitions.* A source at 1.37 epochs is taken once as a whole, and the documents
whose seeded hash lies below a threshold once more. The threshold is the one at which
the sizes below it come nearest to 0.37 of the source. It is found 12 bits at a time
from per-cell sums, so no source is ever sorted or gathered, and a hot source costs
each task 4,096 numbers.

Defined cases: a null or empty text has size 0 and is repeated like any other; a null
source is a source of its own, last in order; sources without words have target 0;
rows that agree in id and text share a hash, so are drawn alike; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawharbor.llm.common import WORD, attach, encoded, free_name, materialize, quoted
from rawharbor.operators.joins import join_reduced

CELL_BITS, LEVELS = 12, 3  # 36 hash bits: 4,096 cells, three times
SEED = "mix-1"
PLAN = ("source_size", "target", "whole", "threshold")


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("bigint")


def draw(id_column: Column, text: Column, seed: str = SEED) -> Column:
    """36 seeded hash bits of a row, the same on every run and for every partitioning."""
    parts = F.concat_ws("|", F.lit(seed), F.coalesce(id_column.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, 9), 16, 10).cast("bigint")


def source_sizes(sized: DataFrame, source: str, size: str) -> DataFrame:
    """``source, source_size``: one row per source, null included."""
    return sized.groupBy(quoted(source).cast("string").alias("source")).agg(F.sum(quoted(size)).alias("source_size"))


def cyclic_weights(sizes: DataFrame, pattern: Sequence[float]) -> DataFrame:
    """Weights dealt in turn to the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), (rank % len(pattern)) + 1))


def water_fill(sizes: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``source, source_size, weight``. Works on one row per source."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    asking = sizes.filter("weight > 0 AND source_size > 0").withColumn("_cap", cap)
    levelled = (
        asking.withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(budget_share)))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_caps")) / F.col("_weights"))
        # The first source not filled to its cap sets the level for all after it.
        .withColumn("_open", F.col("_cap") > F.col("_level") * F.col("weight"))
        .withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_caps"), F.col("_level")))).over(whole)["_level"])
    )
    filled = levelled.select(
        "source",
        F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("weight"))).alias("target"),
    )
    joined = sizes.alias("a").join(filled.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return joined.select("a.source", "a.source_size", "a.weight", F.coalesce("b.target", F.lit(0.0)).alias("target"))


def thresholds(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source key: ``whole`` repetitions and the hash ``threshold`` below which a
    document is taken once more. ``drawn`` has ``_key, _size, _hash``."""
    state = targets.select(
        encoded(F.col("source")).alias("_key"),
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("whole"),
        "target",
        "source_size",
    ).select(
        "_key",
        "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("_wanted"),
        F.lit(0).cast("bigint").alias("_cell"),
    )
    state = materialize(state, "mix-state")
    width = CELL_BITS * LEVELS
    for level in range(LEVELS):
        shift = width - CELL_BITS * (level + 1)
        inside = join_reduced(drawn, state, ["_key"], "inner").filter(
            F.shiftright("_draw", shift + CELL_BITS) == F.col("_cell")
        )
        cells = inside.groupBy("_key", F.shiftright("_draw", shift).alias("_next")).agg(F.sum("_size").alias("_sum"))
        order = Window.partitionBy("_key").orderBy("_next")
        # The cell in which the running sum passes what is wanted; at the last level the
        # boundary nearest to it.
        run = cells.withColumn("_to", F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        found = join_reduced(run, state, ["_key"], "inner")
        below = F.col("_to") - F.col("_sum")
        goes_on = F.col("_to") > F.col("_wanted")
        if level == LEVELS - 1:
            goes_on = (below + F.col("_to")) > 2 * F.col("_wanted")
        step = found.groupBy("_key").agg(
            F.min(F.when(goes_on, F.struct(F.col("_next"), below.alias("_below")))).alias("_hit"),
            F.max("_next").alias("_last"),
        )
        # No cell passes (all of the range is taken): the threshold lies past its end.
        end = F.shiftleft(F.col("_cell") + 1, CELL_BITS)
        state = (
            state.join(step, "_key", "left")
            .withColumn("_new", F.coalesce(F.col("_hit._next"), end))
            .select("_key", "whole", (F.col("_wanted") - F.coalesce("_hit._below", F.lit(0))).alias("_wanted"), F.col("_new").alias("_cell"))
        )
        state = materialize(state, "mix-state")
    return state.select("_key", "whole", F.col("_cell").alias("threshold"))


def mix(
    docs: DataFrame,
    out: str,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = SEED,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` and a struct named ``out``: ``size``, ``source_size``, ``target`` and
    ``repeats`` (how often the mix holds the document; 0 leaves it out).

    ``weights`` are dealt in turn to the sources by code point, null last; the mix
    shall hold ``budget_share`` times all words, no source more than ``max_epochs`` times.
    """
    narrow = materialize(
        docs.select(
            encoded(quoted(source)).alias("_key"),
            quoted(source).cast("string").alias("source"),
            word_count(quoted(text)).alias("_size"),
            draw(quoted(id_column), quoted(text), seed).alias("_draw"),
        ),
        "mix-sizes",
    )
    targets = materialize(
        water_fill(cyclic_weights(source_sizes(narrow, "source", "_size"), weights), budget_share, max_epochs), "mix-targets"
    )
    found = thresholds(narrow.select("_key", "_size", "_draw"), targets)
    plan = targets.withColumn("_key", encoded(F.col("source"))).join(found, "_key")
    key, size, hashed, mixed = (free_name(docs, n) for n in ("_key", "_size", "_draw", "_plan"))
    rows = docs.withColumns(
        {
            key: encoded(quoted(source)),
            size: word_count(quoted(text)),
            hashed: draw(quoted(id_column), quoted(text), seed),
        }
    )
    plan = plan.select(F.col("_key").alias(key), *[F.col(c).alias(f"{mixed}_{c}") for c in PLAN])
    joined = attach(rows, plan, key)
    p = {c: quoted(f"{mixed}_{c}") for c in PLAN}
    answer = F.struct(
        quoted(size).alias("size"),
        p["source_size"].alias("source_size"),
        p["target"].alias("target"),
        (p["whole"] + (quoted(hashed) < p["threshold"]).cast("bigint")).alias("repeats"),
    )
    return joined.select(*[quoted(c) for c in docs.columns if c != out], answer.alias(out))


def repeated(mixed: DataFrame, out: str) -> DataFrame:
    """Each document as often as the mix holds it, without the struct ``out``."""
    copies = F.explode(F.array_repeat(F.lit(True), quoted(out)["repeats"].cast("int")))
    copy = free_name(mixed, "_copy")
    return mixed.withColumn(copy, copies).drop(copy).drop(out)
