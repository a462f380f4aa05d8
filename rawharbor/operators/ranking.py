"""First, best, largest and leading rows.

"One per group" is always an aggregate over ``struct`` order, never a window: it
combines inside every task before the shuffle, so a hot group stays cheap.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rawharbor.functions.nulls import column
from rawharbor.session import fresh_dir, small_table

EXPORT_CAP = 1_048_575
# Up to here a sort with a limit keeps n rows per task and merges them in one.
TOP_K_ROWS = 1_000
# Relative accuracy of the quantile sketch that narrows longer prefixes.
SKETCH_ACCURACY = 10_000
UNHASHED_TYPES = (T.MapType, T.VariantType)
ORDERED_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: Sequence[str]) -> DataFrame:
    """The row that comes first in ``order``, per group."""
    best = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")


def largest_per(df: DataFrame, by: Sequence[str], size: str, tie: str, values: Sequence[str]) -> DataFrame:
    """The row of greatest size per group, a missing size last, ties to the smallest ``tie``."""
    # Text cannot be negated, so the smallest (missing, -size, tie) is wanted.
    order = F.struct(F.col(size).isNull(), -F.col(size), F.col(tie))
    return df.groupBy(*by).agg(F.min_by(F.struct(*values), order).alias("_best")).select(*by, "_best.*")


def head_rows(df: DataFrame, keys: Sequence[str], n: int, total: int | None = None) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``, in that order; 0 means all of them,
    as they are.

    A short prefix is a top-k. A longer one must not be merged in a single task:
    rows that cannot belong to it are filtered out by a quantile of the leading
    key, the rest is range-partitioned on all keys, and each row is kept by its
    rank, which is its place in the partition plus the sizes of those before.
    """
    if n <= 0:
        return df
    order = [column(k) for k in keys]
    if n <= TOP_K_ROWS:
        return df.orderBy(*order).limit(n)

    # Ranks and partition sizes must come from one and the same partitioning, so
    # the placed rows are written before either is used.
    path = fresh_dir(df.sparkSession, "placed")
    # Rows equal in all keys are spread by a hash, so a hot key is not one partition.
    spread = [F.xxhash64(*[column(f.name) for f in df.schema if not isinstance(f.dataType, UNHASHED_TYPES)])]
    (
        _narrow(df, keys[0], n, df.count() if total is None else total)
        .repartitionByRange(*order, *spread)
        .sortWithinPartitions(*order, *spread)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumns(
            {"_part": F.shiftright("_row", 33), "_place": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}
        )
        .drop("_row")
        .where(F.col("_place") < n)
        .write.parquet(path)
    )
    placed = df.sparkSession.read.parquet(path)
    # One size per partition: as many values as the shuffle has partitions.
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    kept, left = placed, n
    for part in sorted(sizes):
        if sizes[part] >= left:
            # Pushed into the scan: files beyond the last partition are skipped.
            kept = placed.where((F.col("_part") <= part) & ((F.col("_part") < part) | (F.col("_place") < left)))
            break
        left -= sizes[part]
    return kept.orderBy(*order).drop("_part", "_place")


def _narrow(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """Drop rows whose leading key is certainly beyond the first ``n`` rows."""
    number, share = _order_number(df, key), n / max(total, 1) + 2 / SKETCH_ACCURACY
    if number is None or share >= 0.5:
        return df
    sketch = F.percentile_approx(number, share, SKETCH_ACCURACY)
    found = df.agg(sketch.alias("cut")).select(F.col("cut").cast("string"), F.typeof("cut").alias("kind")).first()
    if found["cut"] is None:
        return df
    inside = column(key).isNull() | (number <= F.lit(found["cut"]).cast(found["kind"]))
    # The sketch is approximate, so its cut is used only if enough rows lie inside it.
    enough = df.agg(F.count_if(inside).alias("n")).first()["n"] >= n
    return df.where(inside) if enough else df


def _order_number(df: DataFrame, key: str) -> Column | None:
    """A value that never decreases along the order of the key and has quantiles:
    the key itself, or the first seven bytes of a text read as a number."""
    kind = df.schema[key].dataType
    if isinstance(kind, ORDERED_TYPES):
        return column(key)
    if isinstance(kind, T.StringType):
        bytes_ = F.hex(F.substring(column(key).cast("binary"), 1, 7))
        return F.conv(F.rpad(bytes_, 14, "0"), 16, 10).cast("bigint")
    return None


@dataclass(frozen=True)
class Ranked:
    """Rows written once in the order of their keys, each part of them with its ranks.

    ``starts`` holds the rank of the first row of each part: as many values as the range
    partitioning had partitions.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    place: str
    parts: tuple[int, ...]
    starts: tuple[int, ...]
    total: int

    def ranked(self, name: str) -> DataFrame:
        """All rows with their rank, from 0."""
        offsets = small_table(self.rows.sparkSession, list(zip(self.parts, self.starts)), "_part bigint, _start bigint")
        part, at = F.shiftright(column(self.place), 33), column(self.place).bitwiseAND(F.lit((1 << 33) - 1))
        joined = self.rows.withColumn("_part", part).join(offsets, "_part")
        return joined.withColumn(name, F.col("_start") + at).drop("_part", "_start", *([] if name == self.place else [self.place]))

    def between(self, first: int, end: int) -> DataFrame:
        """The rows of ranks from ``first`` up to ``end``, in order: one range of a stored column,
        which skips the files and row groups outside it."""
        if first >= min(end, self.total):
            return self.rows.drop(self.place).limit(0)
        inside = column(self.place) >= self._id(first)
        if end < self.total:
            inside &= column(self.place) < self._id(end)
        return self.rows.where(inside).orderBy(self.place).drop(self.place)

    def page(self, number: int, size: int) -> DataFrame:
        """A page of ``size`` rows, counted from 0."""
        return self.between(number * size, (number + 1) * size)

    def pages(self, size: int) -> DataFrame:
        """``page``, the keys of its first row, and ``rows``: one row per page."""
        rank = "_rank"
        heads = self.ranked(rank).where(F.col(rank) % size == 0)
        rows = F.least(F.lit(size), F.lit(self.total) - F.col(rank))
        return heads.select(F.floor(F.col(rank) / size).alias("page"), *[column(k) for k in self.keys], rows.cast("bigint").alias("rows"))

    def _id(self, rank: int) -> int:
        at = bisect_right(self.starts, rank) - 1
        return (self.parts[at] << 33) + rank - self.starts[at]


def rank_rows(df: DataFrame, keys: Sequence[str], place: str = "_place") -> Ranked:
    """Order rows by ``keys`` in one pass. Each partition of a range partitioning counts its
    own rows; one number per partition comes to the driver. Rows equal in all keys are
    spread by a hash, so a hot key is not one partition."""
    order = [column(k) for k in keys]
    spread = F.xxhash64(*[column(f.name) for f in df.schema if not isinstance(f.dataType, UNHASHED_TYPES)])
    return _written(df.repartitionByRange(*order, spread).sortWithinPartitions(*order, spread), tuple(keys), place)


def place_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows with their place in the order of the table's partitions, from 0."""
    return _written(df, (), name).ranked(name)


def _written(placed: DataFrame, keys: tuple[str, ...], place: str) -> Ranked:
    """Rows written as they lie in their partitions, with what numbers them."""
    path = fresh_dir(placed.sparkSession, "ranked")
    placed.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = placed.sparkSession.read.parquet(path)
    parts, starts, total = [], [], 0
    for row in rows.groupBy(F.shiftright(column(place), 33).alias("part")).count().orderBy("part").collect():
        parts.append(row["part"])
        starts.append(total)
        total += row["count"]
    return Ranked(rows, keys, place, tuple(parts), tuple(starts), total)


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with their place in the order of ``keys``, from 0."""
    return rank_rows(df, keys, name).ranked(name)


def capped(df: DataFrame, keys: Sequence[str], cap: int = EXPORT_CAP) -> DataFrame:
    """At most ``cap`` rows in key order, with a flag that says whether rows were left out."""
    total = df.count()
    rows = head_rows(df, keys, cap, total) if total > cap else df
    return rows.withColumn("truncated", F.lit(total > cap))


def key_page(
    df: DataFrame, key: str | Sequence[str], after: object | Sequence[object] | None, size: int
) -> DataFrame:
    """The next page after a key: a range filter that reaches the scan, in place
    of an offset that reads and throws away everything before it.

    A key that is repeated must be followed by columns that tell its rows apart, and
    ``after`` then holds a value for each (nulls come first). A page is checked: if its
    last key goes on behind it, rows would be lost, so the query fails.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df
    if after is not None:
        values = list(after) if isinstance(after, (list, tuple)) else [after]
        if len(values) != len(keys):
            raise ValueError(f"{len(keys)} keys need as many values to start after")
        beyond = F.lit(False)
        for i in reversed(range(len(keys))):
            value = F.lit(values[i])
            later = column(keys[i]).isNotNull() if values[i] is None else column(keys[i]) > value
            beyond = later | (column(keys[i]).eqNullSafe(value) & beyond)
        # The leading comparison alone can be pushed into the scan.
        first = F.lit(True) if values[0] is None else column(keys[0]) >= F.lit(values[0])
        rows = df.where(first & beyond)
    page = head_rows(rows, keys, size)
    last = page.orderBy(*[column(k).desc_nulls_last() for k in keys]).select(*[column(k) for k in keys]).first()
    if last is not None:
        tie = reduce(lambda a, b: a & b, [column(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, last)])
        if rows.where(tie).count() > page.where(tie).count():
            raise ValueError(f"the key {keys} is repeated across a page: add columns that tell its rows apart")
    return page
