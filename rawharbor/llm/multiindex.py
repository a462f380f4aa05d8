"""Embedding near-duplicates by an inverted multi-index.

Each half of the vectors has a codebook of its own, so a vector lies in one cell of a
product grid. A query visits cells by a lower bound of the distance to them: how far it
lies behind the plane between its own codeword and the cell's, in both halves, squared
and added. In the order of that sum (the multi-sequence order: for every codeword of
the first half, those of the second as far as the sum allows) it stops at a limit that is
calibrated for the target recall, and every vector met is then compared exactly.

With ``target_recall=1.0`` the limit is the squared distance at the wanted cosine, and no
vector can be missed. Below it, the limit is a quantile over a bounded sample: of
neighbours made at exactly the wanted cosine in random directions, and of the real
neighbours that the sample holds; the larger of the two counts.

Cells are cut into blocks of bounded size, and so are the queries that visit a cell, so
that a hot cell is many small matrix products. A block returns link counts and, instead
of all its links, one edge per vector that keeps linked vectors connected.

The codebooks are fitted on ``SAMPLE`` vectors, picked by hash; every vector is indexed.

Defined cases: null, zero or empty vectors, and those with null or non-finite parts, link
with nothing; vectors of different length link with nothing; repeated rows are vectors of
their own; a component's id is the least ``vec_id`` in it (null if there is none); other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawharbor.llm.common import materialize, quoted
from rawharbor.llm.components import connected
from rawharbor.operators.joins import join_reduced
from rawharbor.session import prepare_python

SAMPLE = 8192  # vectors per length that codebooks and limit are fitted on
PER_CELL = 200  # vectors a cell shall hold on average
MOST_CODEWORDS = 512  # per half; the grid has their square
BLOCK = 2048  # vectors, or queries, in one matrix product
SEED = 7


def fit_codebook(points: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from distinct seeded starts; empty codewords stay where they are."""
    points = np.unique(points, axis=0)
    if len(points) <= size:
        return points
    pick = np.random.default_rng(SEED).choice(len(points), size, replace=False)
    centres = points[np.sort(pick)].copy()
    for _ in range(rounds):
        nearest = squared(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=size)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0.0)


class Grid:
    """Two codebooks and the limit of a traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray, half: int):
        self.books = (first, second)
        self.half = half
        self.apart = [np.sqrt(np.maximum(squared(b, b), 1e-300)) for b in self.books]
        self.limit = np.inf

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, : self.half], unit[:, self.half :]

    def bounds(self, unit: np.ndarray) -> list[np.ndarray]:
        """Squared lower bounds of the distance to the region of each codeword, per half."""
        out = []
        for part, book, apart in zip(self.halves(unit), self.books, self.apart):
            d = squared(part, book)
            own = d.argmin(axis=1)
            behind = np.maximum(d - d[np.arange(len(d)), own][:, None], 0.0) / (2 * apart[own])
            behind[np.arange(len(d)), own] = 0.0
            out.append(behind**2)
        return out

    def cell(self, unit: np.ndarray) -> np.ndarray:
        own = [squared(p, b).argmin(axis=1) for p, b in zip(self.halves(unit), self.books)]
        return own[0] * len(self.books[1]) + own[1]

    def needed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The bound at which a traversal from ``left`` meets the cell of ``right``."""
        first, second = self.bounds(left)
        cell, rows, wide = self.cell(right), np.arange(len(left)), len(self.books[1])
        return first[rows, cell // wide] + second[rows, cell % wide]

    def visits(self, unit: np.ndarray) -> list[np.ndarray]:
        wide, out = len(self.books[1]), []
        for first, second in zip(*self.bounds(unit)):
            by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
            near = by_first[: np.searchsorted(first[by_first], self.limit, side="right")]
            reach = np.searchsorted(second[by_second], self.limit - first[near], side="right")
            out.append(np.concatenate([i * wide + by_second[:n] for i, n in zip(near, reach)]).astype(np.int64))
        return out


def fit_grid(sample: np.ndarray, rows: int, least_cosine: float, target_recall: float) -> Grid:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    words = int(np.clip(np.ceil(np.sqrt(rows / PER_CELL)), 1, min(MOST_CODEWORDS, max(1, len(unit) // 16))))
    half = max(1, unit.shape[1] // 2)
    grid = Grid(fit_codebook(unit[:, :half], words), fit_codebook(unit[:, half:], words), half)
    exact = 2 - 2 * least_cosine + 1e-9
    grid.limit = exact
    if target_recall < 1.0:
        noise = np.random.default_rng(SEED).standard_normal(unit.shape)
        noise -= (noise * unit).sum(1)[:, None] * unit
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        good = length[:, 0] > 1e-12
        made = least_cosine * unit[good] + np.sqrt(1 - least_cosine**2) * noise[good] / length[good]
        found = [grid.needed(unit[good], made)]
        close = np.argwhere(np.triu(unit[:2048] @ unit[:2048].T >= least_cosine, 1))
        found.append(grid.needed(unit[close[:, 0]], unit[close[:, 1]]))
        tops = [np.quantile(f, target_recall) for f in found if len(f)]
        grid.limit = min(exact, max(tops, default=exact) + 1e-12)
    return grid


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def _place(grids: dict[int, Grid]):
    """Cell and visits of each vector; the length of the vectors is part of a cell's number."""

    def run(vectors: pa.Array) -> pa.Array:
        cells, visits = [], []
        for value in vectors:
            x = np.array(value.as_py(), np.float64)[None, :]
            grid = grids[x.shape[1]]
            unit = x / np.linalg.norm(x)
            base = x.shape[1] << 32
            cells.append(base + int(grid.cell(unit)[0]))
            visits.append(base + grid.visits(unit)[0])
        cuts = np.concatenate([[0], np.cumsum([len(v) for v in visits])]).astype(np.int32)
        flat = np.concatenate(visits) if visits else np.empty(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(cells, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["cell", "visits"]
        )

    return run


def _links(least_cosine: float):
    """Link counts of a block's queries, and edges that connect what is linked."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("row_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not members.num_rows or not queries.num_rows:
            return schema.empty_table()
        m_id, q_id = np.asarray(members["member"].combine_chunks()), np.asarray(queries["query"].combine_chunks())
        m, q = _matrix(members["member_vector"].combine_chunks()), _matrix(queries["query_vector"].combine_chunks())
        cosine = (q @ m.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1))
        linked = (cosine >= least_cosine) & (q_id[:, None] != m_id[None, :])
        counts = linked.sum(axis=1)
        rows, columns = np.nonzero(linked)
        q_root, m_root = q_id.copy(), m_id.copy()
        while True:  # the least id spreads over the block's links
            before = q_root.sum(dtype=object), m_root.sum(dtype=object)
            np.minimum.at(q_root, rows, m_root[columns])
            np.minimum.at(m_root, columns, q_root[rows])
            if before == (q_root.sum(dtype=object), m_root.sum(dtype=object)):
                break
        q_say, m_say = counts > 0, m_root != m_id
        return pa.table(
            [
                pa.array(np.concatenate([q_id[q_say], m_id[m_say]])),
                pa.array(np.concatenate([counts[q_say], np.zeros(m_say.sum(), np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([q_root[q_say], m_root[m_say]])),
            ],
            schema=schema,
        )

    return run


def embedding_duplicates(
    vectors: DataFrame,
    least_cosine: float = 0.9,
    target_recall: float = 0.999,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``."""
    spark = vectors.sparkSession
    prepare_python(spark)
    rows = materialize(
        vectors.select(
            F.monotonically_increasing_id().alias("row_id"),
            quoted(id_column).alias("vec_id"),
            quoted(vector).cast("array<double>").alias("vector"),
        ),
        "vectors",
    )
    sound = (
        F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    usable = rows.filter(F.coalesce(sound, F.lit(False)))
    grids = {}
    for length, number in usable.groupBy(F.size("vector")).count().collect():
        picked = usable.filter(F.size("vector") == length).orderBy(F.xxhash64("row_id")).limit(SAMPLE).select("vector")
        grids[length] = fit_grid(_matrix(picked.toArrow()["vector"].combine_chunks()), number, least_cosine, target_recall)
    place = F.arrow_udf(_place(grids), "struct<cell:bigint,visits:array<bigint>>").asNondeterministic()
    placed = materialize(usable.select("row_id", "vector", place("vector").alias("p")).select("row_id", "vector", "p.*"), "cells")
    visited = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("queries"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("members")).join(visited, "cell")
    cells = materialize(
        cells.select(
            "cell",
            F.ceil(F.col("members") / BLOCK).alias("m_blocks"),
            F.ceil(F.col("queries") / BLOCK).alias("q_blocks"),
        ),
        "grid",
    )
    own_block = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    members = join_reduced(placed.select("row_id", "vector", "cell"), cells, ["cell"], "inner").select(
        "cell", own_block("m_blocks").alias("m_block"), every("q_blocks").alias("q_block"),
        F.col("row_id").alias("member"), F.col("vector").alias("member_vector"),
    )
    queries = join_reduced(
        placed.select("row_id", "vector", F.explode("visits").alias("cell")), cells, ["cell"], "inner"
    ).select("cell", every("m_blocks").alias("m_block"), own_block("q_blocks").alias("q_block"),
        F.col("row_id").alias("query"), F.col("vector").alias("query_vector"),
    )
    key = ["cell", "m_block", "q_block"]
    found = materialize(
        members.groupBy(*key)
        .cogroup(queries.groupBy(*key))
        .applyInArrow(_links(least_cosine), "row_id bigint, links bigint, root bigint"),
        "links",
    )
    counts = found.groupBy("row_id").agg(F.sum("links").alias("n_links"))
    edges = found.filter("row_id <> root").select(F.col("row_id").alias("a"), F.col("root").alias("b"))
    labels = connected(edges).select(F.col("node").alias("row_id"), "label")
    named = rows.select("row_id", "vec_id").join(labels, "row_id", "left").withColumn("label", F.coalesce("label", "row_id"))
    heads = named.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    return (
        join_reduced(named, heads, ["label"], "inner")
        .join(counts, "row_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            "component_id",
            F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
