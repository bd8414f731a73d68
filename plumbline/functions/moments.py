"""Second moments of column pairs from plain sums.

Built-in ``corr`` and ``regr_*`` keep six or more buffers per pair, and an aggregate
with over a hundred of them leaves code generation.  Sums of centred values need one
buffer per column and per pair, and centring keeps them numerically stable.  Pairs
with missing values get their own restricted sums, so each pair uses exactly the
rows where both sides are present.

Where the sums of many columns would take more than one scan, each task adds up
matrix products of its Arrow batches instead, and one scan serves all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.schema import col

MAX_BUFFERS = 80


@dataclass(frozen=True)
class Pair:
    """Count, means and centred sums of squares and products of one pair."""

    n: int
    mean_x: float
    mean_y: float
    sxx: float
    syy: float
    sxy: float

    @property
    def r(self) -> float | None:
        spread = math.sqrt(self.sxx) * math.sqrt(self.syy) if self.sxx > 0 and self.syy > 0 else 0.0
        return self.sxy / spread if spread else None

    @property
    def slope(self) -> float | None:
        return self.sxy / self.sxx if self.sxx > 0 else None

    @property
    def intercept(self) -> float | None:
        return None if self.slope is None else self.mean_y - self.slope * self.mean_x

    @property
    def r2(self) -> float | None:
        if self.sxx <= 0:
            return None
        return 1.0 if self.syy <= 0 else min(1.0, self.sxy**2 / (self.sxx * self.syy))


def pair_moments(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], Pair]:
    """Moments for every pair: one scan for means, then one per block of sums."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    if not columns:
        return {}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in (("n", F.count(col(c))), ("m", F.avg(_num(c))))],
    ).first()
    rows = row["rows"]
    n = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    mean = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}
    d = {c: _num(c) - F.lit(mean[c]) for c in columns}
    full = {c for c in columns if n[c] == rows}

    sums: dict[tuple, Column] = {}
    for x, y in pairs:
        xs, ys = _scopes(x, y, full)
        for c, scope in ((x, xs), (y, ys)):
            v = d[c] if scope is None else F.when(col(scope).isNotNull(), d[c])
            sums.setdefault(("s", c, scope), F.sum(v))
            sums.setdefault(("q", c, scope), F.sum(v * v))
            if scope is not None or c not in full:
                sums.setdefault(("n", c, scope), F.count(v))
        sums.setdefault(("p", x, y), F.sum(d[x] * d[y]))
    keys = list(sums)
    if len(keys) <= MAX_BUFFERS:
        row = df.agg(*[sums[k].alias(str(j)) for j, k in enumerate(keys)]).first()
        got = {k: row[j] or 0.0 for j, k in enumerate(keys)}
    else:
        got = _by_products(df.select(*[v.alias(str(i)) for i, v in enumerate(d.values())]), columns, keys)

    out = {}
    for x, y in pairs:
        xs, ys = _scopes(x, y, full)
        count = int(got.get(("n", x, xs), rows))
        if not count:
            out[x, y] = Pair(0, 0.0, 0.0, 0.0, 0.0, 0.0)
            continue
        sx, sy = got["s", x, xs], got["s", y, ys]
        out[x, y] = Pair(
            count,
            mean[x] + sx / count,
            mean[y] + sy / count,
            max(0.0, got["q", x, xs] - sx * sx / count),
            max(0.0, got["q", y, ys] - sy * sy / count),
            got["p", x, y] - sx * sy / count,
        )
    return out


def _by_products(centred: DataFrame, columns: list[str], keys: list[tuple]) -> dict[tuple, float]:
    """The sums of ``keys`` for all column pairs from one scan; four numbers a pair reach the driver."""
    k = len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.slice(at, 4096).columns])
                seen = ~np.isnan(x)
                x, here = np.where(seen, x, 0.0), seen.astype(float)
                total += np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        i, j = np.divmod(np.arange(k * k), k)
        names = ["i", "j", "n", "s", "q", "p"]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t.ravel()) for t in total)], names)

    parts = centred.mapInArrow(products, "i int, j int, n double, s double, q double, p double")
    rows = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nsqp"]).collect()
    at = {(columns[r["i"]], columns[r["j"]]): r for r in rows}
    # a sum of x "where y is present" is the pair (x, y); without a condition it is (x, x)
    return {key: at[key[1], key[2] or key[1]][key[0]] if at else 0.0 for key in keys}


def _num(name: str) -> Column:
    return col(name).cast("double")


def _scopes(x: str, y: str, full: set[str]) -> tuple[str | None, str | None]:
    """Which other column restricts each side's sums; none if that side is complete anyway."""
    return (None if y in full else y), (None if x in full else x)
