"""Features and target put side by side on an explicit row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.functions.nulls import column
from rawharbor.operators.joins import join_reduced
from rawharbor.operators.ranking import place_rows


def append_target(
    features: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str] | str
) -> DataFrame:
    """Keep every feature row; existing columns of the target's names are replaced.

    A key may stand in the target only once; the query fails if one is repeated.
    """
    added = [columns] if isinstance(columns, str) else list(columns)
    kept = features.drop(*[c for c in added if c not in key])
    _refuse_repeated(target, key, "target")
    values = target.select(*[column(k) for k in key], F.struct(*[column(c).alias(c) for c in added]).alias("_target"))
    joined = join_reduced(kept, values, list(key))
    names = [c for c in kept.columns if c not in key]
    return joined.select(*[column(k) for k in key], *[column(c) for c in names], *[F.col("_target")[c].alias(c) for c in added])


def _refuse_repeated(df: DataFrame, key: Sequence[str], side: str) -> None:
    """Fail if a key stands on several rows. Keys are counted in every task before the shuffle,
    so a key of very many rows costs no more than another."""
    repeated = df.groupBy(*[column(k) for k in key]).count().where("count > 1").drop("count").take(1)
    if repeated:
        raise ValueError(f"a key of {list(key)} is repeated in the {side}: {tuple(repeated[0])}")


def concat_target(features: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep every key of either side. Both sides may carry a column of the same
    name; the target's then gets the suffix ``_target``.

    A key may stand on each side only once; the call fails if one is repeated, as rows
    would multiply.
    """
    _refuse_repeated(features, key, "features")
    _refuse_repeated(target, key, "target")
    return features.join(target.withColumnsRenamed(_suffixed(features, target, key)), list(key), "full_outer")


def _suffixed(features: DataFrame, target: DataFrame, key: Sequence[str]) -> dict[str, str]:
    return {c: f"{c}_target" for c in target.columns if c not in key and c in features.columns}


def concat_by_position(features: DataFrame, target: DataFrame, position: str = "position") -> DataFrame:
    """Two tables without a key side by side: first row to first row, in the order of their
    partitions; the longer one goes on with nulls beside it. Columns are named as by
    :func:`concat_target`.

    A row's position is its place in its partition plus the sizes of those before, of which
    one number per partition comes to the driver.
    """
    clash = {c.lower() for c in features.columns + target.columns} & {position.lower()}
    if clash:
        raise ValueError(f"both sides are numbered by {position!r}, which is a column already")
    left, right = (place_rows(df, position) for df in (features, target))
    return left.join(right.withColumnsRenamed(_suffixed(features, target, [])), position, "full_outer")
