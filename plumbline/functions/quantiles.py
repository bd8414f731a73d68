"""Exact quantiles whose memory does not grow with the data.

Spark's ``percentile`` keeps every distinct value of a column in one task.  That
is fine for a few hundred thousand values and hopeless for a continuous column of
a large table.  Beyond ``in_memory`` values this module selects instead, for all
columns and probabilities together:

1. one scan counts the values, finds their range and mean, and keeps a KLL sketch, whose
   values a little below and above each wanted share should bracket its rank;
2. one grouped count tells how many values lie below, at and between the ends, and,
   once few enough are expected between them, which values those are.

Up to some millions of values these two scans suffice; beyond, each further pair
narrows the brackets by what the sketch can tell apart, some thousand times.
The counts are exact, so a wrong guess in the first step costs a round and never a
wrong result.  The wanted value is an end, or one of the values counted between the
ends, or lies strictly between them in a later round.  A round drops both ends of a
bracket, so ties cannot stall it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.config import IN_MEMORY_VALUES
from plumbline.functions.schema import col

# The size parameter of a sketch, and of all sketches of one scan together.
ACCURACY, ALL_ACCURACY = 16_000, 2_000_000
FINISH_ROWS = 50_000


def described(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    in_memory: int = IN_MEMORY_VALUES,
    finish: int = FINISH_ROWS,
    accuracy: int = ACCURACY,
) -> dict[str, dict]:
    """n, low, high, mean and linear-interpolated quantiles per column; ``None`` for those of an all-missing column."""
    if not columns:
        return {}
    accuracy = max(8, min(accuracy, ALL_ACCURACY // len(columns)))
    spread = _margin(accuracy)
    row = df.agg(
        *[
            e.alias(f"{k}{i}")
            for i, c in enumerate(columns)
            for k, e in (
                ("n", F.count(col(c))), ("low", F.min(number(c))), ("high", F.max(number(c))), ("mean", F.avg(number(c))),
                ("ends", _sketched(number(c), [p + d for p in probs for d in (-spread, spread)], accuracy)),
            )
        ]
    ).first()
    out = {c: {k: row[f"{k}{i}"] for k in ("n", "low", "high", "mean")} | {"quantiles": [None] * len(probs)} for i, c in enumerate(columns)}
    small = [c for c in columns if 0 < out[c]["n"] <= in_memory]
    if small:
        wanted = F.array(*map(F.lit, probs))
        values = df.agg(*[F.percentile(number(c), wanted).alias(str(i)) for i, c in enumerate(small)]).first()
        for i, c in enumerate(small):
            out[c]["quantiles"] = list(values[i])
    todo = []
    for i, c in enumerate(columns):
        n = out[c]["n"]
        if n <= in_memory:
            continue
        bounds: dict[int, tuple] = {}
        for j, p in enumerate(probs):
            low = out[c]["low"] if p <= spread else row[f"ends{i}"][2 * j]
            high = out[c]["high"] if p >= 1 - spread else row[f"ends{i}"][2 * j + 1]
            bounds |= {r: (low, high) for r in _ranks(n, p)}
        todo += [_Target(c, r, n, ends=e, expected=_expected(n, accuracy)) for r, e in bounds.items()]
    found = _selected(df, todo, finish, accuracy)
    for c, stats in found.items():
        out[c]["quantiles"] = [_interpolate(out[c]["n"], p, stats) for p in probs]
    return out


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    in_memory: int = IN_MEMORY_VALUES,
    finish: int = FINISH_ROWS,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; ``None`` for an all-missing column."""
    return {c: f["quantiles"] for c, f in described(df, columns, probs, in_memory, finish, accuracy).items()}


def _margin(accuracy: int) -> float:
    """How far from a share a sketch's value for it may lie, but for rare cases."""
    return 3.0 / accuracy**0.9


def _expected(n: int, accuracy: int) -> float:
    return min(float(n), 2 * _margin(accuracy) * n + 1)


def _sketched(v: Column, shares: list[float], accuracy: int) -> Column:
    """Aggregate: values at about these shares; NULL without values."""
    sketch = F.kll_sketch_agg_double(v, F.lit(accuracy))
    shares = F.array(*[F.lit(min(1.0, max(0.0, p))) for p in shares])
    return F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(sketch, shares))


def number(name: str) -> Column:
    return col(name).cast("double")


@dataclass
class _Target:
    """A wanted rank and the open interval it is known to lie in."""

    column: str
    rank: int
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    ends: tuple[float, float] = (0.0, 0.0)
    expected: float = 0.0


def _selected(df: DataFrame, todo: list[_Target], finish: int, accuracy: int) -> dict[str, dict[int, float]]:
    """Value at each 0-based rank, per column."""
    found: dict[str, dict[int, float]] = {t.column: {} for t in todo}
    while todo:
        with_values = sum({(t.column, t.ends): t.expected for t in todo}.values()) <= finish
        tally = _tally(df, todo, with_values)
        todo = [t for t in todo if not _resolve(t, tally[t.column], found)]
        if todo:
            _bracket(df, todo, accuracy)
    return found


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(id, v)``: one row per value, the column as its position from 1.

    Expressions on these two columns are compiled once, not once per column.
    """
    named = df.select(*[number(c).alias(str(i + 1)) for i, c in enumerate(columns)])
    if len(columns) == 1:
        rows = named.select(F.lit(1).alias("id"), F.col("1").alias("v"))
    else:
        rows = named.unpivot([], named.columns, "id", "v").select(F.col("id").cast("int").alias("id"), "v")
    return rows.where("v is not null")


def _per_id(values: list) -> Column:
    """The value that belongs to a row's ``id``."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("id"))


def _bracket(df: DataFrame, todo: list[_Target], accuracy: int) -> None:
    """Set two ends around each target: one sketch per column and interval."""
    spread = _margin(accuracy)
    spans: dict[tuple, list[_Target]] = {}
    for t in todo:
        spans.setdefault((t.column, t.low, t.high), []).append(t)
    sketches = []
    for i, ((c, low, high), targets) in enumerate(spans.items()):
        v = _within(number(c), low, high)
        shares = [(t.rank - t.below) / max(1, t.size - 1) + d for t in targets for d in (-spread, spread)]
        sketches += [_sketched(v, shares, accuracy).alias(f"q{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*sketches).first()
    for i, targets in enumerate(spans.values()):
        for j, t in enumerate(targets):
            p = (t.rank - t.below) / max(1, t.size - 1)
            a, b = row[f"q{i}"][2 * j : 2 * j + 2]
            t.ends = (a if p > spread else row[f"lo{i}"], b if p < 1 - spread else row[f"hi{i}"])
            t.expected = _expected(t.size, accuracy)


def _tally(df: DataFrame, todo: list[_Target], with_values: bool) -> dict[str, list[tuple]]:
    """``(low, high, value, n)`` per column in ascending order, over all its values.

    A row is a single value (``value`` set) or an open interval between two ends.
    With ``with_values`` the intervals inside brackets come as single values.
    """
    columns = list(dict.fromkeys(t.column for t in todo))
    ends = {c: sorted({e for t in todo if t.column == c for e in t.ends}) for c in columns}
    most = max(map(len, ends.values()))
    v, place = F.col("v"), F.lit(0)
    for j in range(most):
        end = _per_id([ends[c][j] if j < len(ends[c]) else math.nan for c in columns])
        place = place + (v > end).cast("int") + (v >= end).cast("int")
    values = _values(df, columns).select("id", "v", place.alias("place"))
    keep = F.lit(None).cast("double")
    if with_values:
        inside = [
            any(t.column == c and t.ends[0] <= a and b <= t.ends[1] for t in todo)
            for c in columns
            for a, b in _gaps(ends[c], most)
        ]
        at = (F.col("id") - 1) * (most + 1) + F.floor(F.col("place") / 2) + 1
        gap = F.col("place") % 2 == 0
        keep = F.when(gap & F.element_at(F.array(*map(F.lit, inside)), at.cast("int")), v)
    rows = values.groupBy("id", "place", keep.alias("value")).agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, list[tuple]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r["place"], -math.inf if r["value"] is None else r["value"])):
        c = columns[r["id"] - 1]
        (j, at_end), at = divmod(r["place"], 2), ends[c]
        if at_end:
            out[c].append((None, None, at[j], r["n"]))
        else:
            low = at[j - 1] if j else None
            high = at[j] if j < len(at) else None
            out[c].append((low, high, r["value"], r["n"]))
    return out


def _gaps(ends: list[float], most: int) -> list[tuple[float, float]]:
    """The open intervals below, between and above the ends, padded to a common count."""
    edges = [-math.inf, *ends, *[math.inf] * (most + 1 - len(ends))]
    return list(zip(edges, edges[1:]))


def _resolve(t: _Target, tally: list[tuple], found: dict) -> bool:
    below = 0
    for low, high, value, n in tally:
        if t.rank < below + n:
            if value is not None:
                found[t.column][t.rank] = value
                return True
            t.low, t.high, t.below, t.size = low, high, below, n
            return False
        below += n
    raise AssertionError("rank beyond the number of values")


def _within(v: Column, low: float | None, high: float | None) -> Column:
    if low is None and high is None:
        return v
    cond = F.lit(True)
    if low is not None:
        cond = cond & (v > F.lit(low))
    if high is not None:
        cond = cond & (v < F.lit(high))
    return F.when(cond, v)


def _ranks(n: int, p: float) -> set[int]:
    pos = (n - 1) * p
    return {math.floor(pos), math.ceil(pos)}


def _interpolate(n: int, p: float, stats: dict[int, float]) -> float:
    pos = (n - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi:
        return stats[lo]
    return (hi - pos) * stats[lo] + (pos - lo) * stats[hi]
