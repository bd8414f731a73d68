"""Exact k nearest neighbours by pruned blocks.

Training points are grouped around pivots.  Each cell is summarised by its size,
its radius and its few smallest pivot distances.  A query first meets the points of
the cell whose pivot is nearest; the k-th of them bounds its k-th neighbour (where
there are fewer, the summaries do).  It then skips each cell that cannot hold a
nearer point, by the triangle inequality, and because a point is nearer to its own
pivot than to the query's.  Cells that lie near each other
share a block, a crowded cell is cut into several, and queries are cut into chunks:
a query travels once to each block that holds a cell it needs, with the list of
those cells, so what is shuffled grows with blocks and not with cells.  A task holds
one block and one chunk, both of bounded size, and returns its k best per query.

What is skipped depends on the data.  Vectors without clusters, as in many
dimensions, leave nothing to skip, and then every block meets every query: the
work is queries times rows, the price of exactness.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.functions.schema import col
from plumbline.session import materialize

# Rows of a block and of a chunk, and numbers in either, at most.
BLOCK_ROWS = CHUNK_ROWS = 16384
BLOCK_NUMBERS = 1 << 20
MAX_PIVOTS = 512
# Numbers in the temporary tables of a task, and rows of a message to the JVM.
NUMBERS = 1 << 21
MESSAGE = 8192
# Room for rounding when comparing bounds.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, but for rounding."""
    sq = a @ b.T
    sq *= -2.0
    sq += (a * a).sum(1)[:, None]
    sq += (b * b).sum(1)[None, :]
    return sq


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = _squares(a, b)
    return np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)


def _chain(centers: np.ndarray) -> list[int]:
    """Row numbers in an order that steps from each center to the nearest one left."""
    left, order = list(range(1, len(centers))), [0]
    while left:
        d = ((centers[left] - centers[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(d.argmin())))
    return order


def nearest(
    train: DataFrame,
    query: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    payload: str | None = None,
    exclude_self: bool = False,
    block_rows: int | None = None,
    chunk_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """``(query, neighbor, distance, rank[, payload])`` by Euclidean distance, ties by key.

    Keys are whole numbers, or else compared as text, and must not repeat.
    ``exclude_self`` ignores a training point with the query's own key.
    """
    whole = isinstance(train.schema[key].dataType, T.IntegralType) and isinstance(query.schema[key].dataType, T.IntegralType)
    kind = "bigint" if whole else "string"
    payload_type = train.schema[payload].dataType.simpleString() if payload else "int"
    points = train.select(
        col(key).cast(kind).alias("id"),
        col(vector).cast("array<double>").alias("vec"),
        (col(payload) if payload else F.lit(0)).alias("payload"),
    )
    asked = query.select(col(key).cast(kind).alias("qid"), col(vector).cast("array<double>").alias("qvec"))

    size = points.count()
    if size == 0:
        raise ValueError("no training rows")
    need = k + 1 if exclude_self else k
    n_pivots = pivots or max(1, min(MAX_PIVOTS, math.isqrt(size) // 2))
    centers = _matrix(
        [r["vec"] for r in points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n_pivots).select("vec").collect()]
    )
    most = max(256, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, centers.shape[1])))
    block_rows, chunk_rows = block_rows or most, chunk_rows or most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), MESSAGE):
                part = pdf.iloc[i : i + MESSAGE]
                d = _distances(_matrix(part["vec"]), centers)
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype("int32"), reach=d[np.arange(len(part)), cell])

    placed = points.mapInPandas(place, f"id {kind}, vec array<double>, payload {payload_type}, cell int, reach double")

    # Per cell: size, radius and the few nearest members; at most MAX_PIVOTS rows.
    by_reach = Window.partitionBy("cell").orderBy("reach", "id")
    near = (
        placed.select("cell", "reach", "id")
        .withColumn("r", F.row_number().over(by_reach))
        .where(F.col("r") <= need)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("reach")).alias("near"))
    )
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).join(near, "cell")
    summary = {r["cell"]: r for r in cells.collect()}
    ids = np.array(sorted(summary))
    ids = ids[_chain(centers[ids])]
    radius = np.array([summary[c]["radius"] for c in ids])
    near_pad = np.full((len(ids), need), np.inf)
    for i, c in enumerate(ids):
        near_pad[i, : len(summary[c]["near"])] = summary[c]["near"]
    used = centers[ids]

    # Cells go into groups in that order until a group would exceed a block; a larger cell is a group of several blocks.
    group, held, n_blocks = np.empty(len(ids), np.int64), 0, []
    for i, c in enumerate(ids):
        n = summary[c]["n"]
        if not i or held + n > block_rows:
            n_blocks.append(max(1, math.ceil(n / block_rows)))
            held = 0
        held, group[i] = held + n, len(n_blocks) - 1
    firsts = np.searchsorted(group, np.arange(len(n_blocks)))

    between, wide = _distances(used, used), (used * used).sum(1).max()
    between[between == 0.0] = np.inf

    def visits(qvec: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which cells each query has to look into; ``limit`` is a distance that k points keep, or missing."""
        d = _distances(qvec, used)
        slack = SLACK * (1.0 + d.max(1))
        if (open_ := np.flatnonzero(~np.isfinite(limit))).size:
            reachable = (d[open_][:, :, None] + near_pad[None, :, :]).reshape(len(open_), -1)
            kth = min(need, reachable.shape[1]) - 1
            reachable.partition(kth, axis=1)
            limit = limit.copy()
            limit[open_] = reachable[:, kth]
        limit = (limit + slack)[:, None]
        home = d.argmin(1)
        gap = between[home]
        # how far a query is from where its pivot's side ends, but for rounding
        squares = (qvec * qvec).sum(1)[:, None] + wide + np.square(np.where(np.isfinite(limit), limit, 0.0))
        room = 64 * np.finfo(float).eps * squares
        plane = (d * d - np.square(d[np.arange(len(d)), home])[:, None] - room) / (2.0 * gap)
        return (d - radius[None, :] <= limit) & (plane <= limit)

    def slices(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        step = max(1, min(MESSAGE // len(n_blocks), NUMBERS // (len(ids) * need)))
        for i in range(0, len(pdf), step):
            part = pdf.iloc[i : i + step]
            limit = part["bound"].to_numpy(np.float64) if "bound" in part else np.full(len(part), np.nan)
            yield part[["qid", "qvec"]], visits(_matrix(part["qvec"]), limit)

    def homes(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """The nearest cell alone."""
        for i in range(0, len(pdf), MESSAGE):
            part = pdf.iloc[i : i + MESSAGE]
            yield part, _distances(_matrix(part["qvec"]), used).argmin(1)

    def route_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(n_blocks), np.int64)
        for pdf in batches:
            for _, home in homes(pdf):
                n += np.bincount(group[home], minlength=len(n))
        yield pd.DataFrame({"grp": np.arange(len(n), dtype="int32"), "n": n})

    def carry_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, home in homes(pdf):
                yield part.assign(grp=group[home].astype("int32"), cells=list(ids[home].astype("int32")[:, None]))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many queries look into each group of cells."""
        n = np.zeros(len(n_blocks), np.int64)
        for pdf in batches:
            for _, look in slices(pdf):
                n += np.logical_or.reduceat(look, firsts, axis=1).sum(0)
        yield pd.DataFrame({"grp": np.arange(len(n), dtype="int32"), "n": n})

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query for each group of cells that it looks into, with those cells."""
        for pdf in batches:
            for part, look in slices(pdf):
                row, grp = np.nonzero(np.logical_or.reduceat(look, firsts, axis=1))
                at, where = np.nonzero(look)
                ends = np.cumsum(np.unique(at * len(n_blocks) + group[where], return_counts=True)[1])
                yield part.iloc[row].assign(grp=grp.astype("int32"), cells=np.split(ids[where].astype("int32"), ends)[:-1])

    session = train.sparkSession
    groups = session.createDataFrame([(int(c), int(g)) for c, g in zip(ids, group)], "cell int, grp int")

    def spread(count, column):
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def meetings(asked: DataFrame, route, carry):
        """Blocks of points and the chunks of queries that look into them."""
        load = {r["grp"]: r["n"] for r in asked.mapInPandas(route, "grp int, n bigint").groupBy("grp").agg(F.sum("n").alias("n")).collect()}
        # at most MAX_PIVOTS rows
        chunks = [max(1, math.ceil(load.get(g, 0) / chunk_rows)) for g in range(len(n_blocks))]
        grid = session.createDataFrame([(g, b, c) for g, (b, c) in enumerate(zip(n_blocks, chunks))], "grp int, n_blocks int, n_chunks int")
        left = (
            placed.join(F.broadcast(groups), "cell")
            .join(F.broadcast(grid), "grp")
            .withColumn("block", spread("n_blocks", "id"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
            .select("grp", "block", "chunk", "cell", "id", "vec", "payload")
        )
        right = (
            asked.mapInPandas(carry, f"qid {kind}, qvec array<double>, grp int, cells array<int>")
            .join(F.broadcast(grid), "grp")
            .withColumn("chunk", spread("n_chunks", "qid"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            .select("grp", "block", "chunk", "qid", "qvec", "cells")
        )
        return left.groupBy("grp", "block", "chunk").cogroup(right.groupBy("grp", "block", "chunk"))

    plain = np.int64 if whole else np.str_

    def candidates_of(qid: np.ndarray, qvec: np.ndarray, pid: np.ndarray, pvec: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query row, point row, distance) of the k nearest points of each query, and all that tie with them but for rounding."""
        d = _squares(qvec, pvec)
        if exclude_self:
            low, high = np.searchsorted(pid, qid, "left"), np.searchsorted(pid, qid, "right")
            for j in range((high - low).max()):
                own = np.flatnonzero(low + j < high)
                d[own, low[own] + j] = np.inf
        kth = min(need, len(pid)) - 1
        room = 8 * (pvec.shape[1] + 1) * np.finfo(float).eps * ((qvec * qvec).sum(1) + (pvec * pvec).sum(1).max())
        bound = np.partition(d, kth, axis=1)[:, kth] + room
        row, at = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        exact = np.empty(len(row))
        step = max(1, NUMBERS // max(1, pvec.shape[1]))
        for i in range(0, len(row), step):
            part = slice(i, i + step)
            exact[part] = np.sqrt(((pvec[at[part]] - qvec[row[part]]) ** 2).sum(1))
        return row, at, exact

    def best_of(row: np.ndarray, at: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k nearest of each query; of equals those that come first among the points, which are sorted by id."""
        order = np.lexsort((at, exact, row))
        row, at, exact = row[order], at[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], at[rank < k], exact[rank < k]

    def best(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "neighbor": [], "distance": [], "payload": []})
        if not len(points) or not len(queries):
            return empty
        points = points.sort_values("id")
        pid, pvec, extra = points["id"].to_numpy(plain), _matrix(points["vec"]), points["payload"].to_numpy()
        qid, qvec = queries["qid"].to_numpy(plain), _matrix(queries["qvec"])
        members = {c: np.flatnonzero(points["cell"].to_numpy() == c) for c in points["cell"].unique()}
        wanted = np.concatenate(queries["cells"].to_list())
        asks = np.repeat(np.arange(len(queries)), queries["cells"].map(len))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for c, own in members.items():
            rows = asks[wanted == c]
            step = max(1, NUMBERS // len(own))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                row, at, exact = candidates_of(qid[r], qvec[r], pid[own], pvec[own])
                found.append(best_of(r[row], own[at], exact))
            # what a cell gives is merged at once, so that no more than the k best are kept
            found = [best_of(*(np.concatenate(x) for x in zip(*found)))]
        row, at, exact = found[0]
        return pd.DataFrame({"query": qid[row], "neighbor": pid[at], "distance": exact, "payload": extra[at]})

    def kth(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The distance of the k-th of these points, for queries that have as many."""
        found = best(points, queries)
        counts = found.groupby("query", sort=False)["distance"].agg(["size", "max"])
        counts = counts[counts["size"] == k]
        return pd.DataFrame({"query": counts.index.to_numpy(), "bound": counts["max"].to_numpy()})

    if len(ids) > 1:
        bounds = meetings(asked, route_home, carry_home).applyInPandas(kth, f"query {kind}, bound double")
        bounds = bounds.groupBy("query").agg(F.min("bound").alias("bound"))
        asked = materialize(asked.join(bounds, F.col("qid") == F.col("query"), "left").drop("query"), "bounds")
    candidates = meetings(asked, route, carry).applyInPandas(best, f"query {kind}, neighbor {kind}, distance double, payload {payload_type}")
    closest = Window.partitionBy("query").orderBy("distance", "neighbor")
    out = candidates.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= k)
    return out.withColumnRenamed("payload", payload) if payload else out.drop("payload")


def classify(train: DataFrame, query: DataFrame, key: str, vector: str, label: str, k: int = 5, **options) -> DataFrame:
    """``(query, prediction)`` by majority of the k nearest; ties go to the smaller label."""
    votes = nearest(train, query, key, vector, k, label, **options).groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("r"), F.col(label).alias("v")))["v"].alias("prediction"))


def regress(train: DataFrame, query: DataFrame, key: str, vector: str, label: str, k: int = 5, **options) -> DataFrame:
    """``(query, prediction)`` by the mean of the k nearest."""
    return nearest(train, query, key, vector, k, label, **options).groupBy("query").agg(F.avg(label).alias("prediction"))
