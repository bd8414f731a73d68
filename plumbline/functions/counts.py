"""The two shared aggregates: one row per column, and one row per (column, value)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.schema import col, family

# Aggregates with more buffers than this leave whole-stage code generation.
MAX_BUFFERS = 96
# Text columns with a value of more bytes are counted by hash; so many first characters go with it.
HASHED_FROM = 64


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def union_all(parts: list[DataFrame], none: DataFrame | None = None) -> DataFrame:
    """All parts under one another; ``none`` where there is no part."""
    return reduce(DataFrame.unionByName, parts) if parts else none


def per_column(
    df: DataFrame, columns: list[str], measures: Callable[[str], dict[str, Column]], buffers: int = 6, none: str = ""
) -> DataFrame:
    """``(column, *measures)``, one row per column, from one aggregate per chunk of columns.

    ``buffers`` is the number of aggregate buffers one column needs.  Each chunk
    reads only its own columns, so on columnar files chunks do not repeat I/O.
    Without columns the result is empty, its measures being those of ``none``.
    """
    if not columns:
        return empty(df, "column string" + (f", {none}" if none else ""))
    parts = []
    size = max(1, MAX_BUFFERS // buffers)
    for i in range(0, len(columns), size):
        rows = [
            F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in measures(c).items()])
            for c in columns[i : i + size]
        ]
        parts.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    return union_all(parts)


def column_facts(
    df: DataFrame, columns: list[str], measures: Callable[[str], dict[str, Column]], buffers: int = 6
) -> dict[str, T.Row]:
    """``per_column`` on the driver: as many rows as the table has columns."""
    if not columns:
        return {}
    return {r["column"]: r for r in per_column(df, columns, measures, buffers).collect()}


def _storage_kind(dtype: T.DataType) -> T.DataType:
    """Type under which columns of like kind share one grouping."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return T.StringType()
    return dtype


def typed_value_counts(df: DataFrame, columns: list[str]) -> list[tuple[dict[int, str], DataFrame]]:
    """``(id, value, n)`` per kind of type, missing included as a value.

    Grouping on typed values and a small integer instead of strings keeps the
    shuffle narrow; partial aggregation absorbs hot values before the shuffle.
    """
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in columns and not isinstance(f.dataType, T.MapType):
            kinds.setdefault(_storage_kind(f.dataType).simpleString(), []).append(f.name)
    out = []
    for kind, names in kinds.items():
        ids = dict(enumerate(names))
        if len(names) == 1:
            values = df.select(F.lit(0).alias("id"), col(names[0]).cast(kind).alias("value"))
        else:
            values = df.select(*[col(c).cast(kind).alias(str(i)) for i, c in ids.items()]).unpivot(
                [], [str(i) for i in ids], "id", "value"
            ).select(F.col("id").cast("int").alias("id"), "value")
        out.append((ids, values.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))))
    return out


def _named(ids: dict[int, str]) -> Column:
    return F.element_at(F.array(*[F.lit(ids[i]) for i in sorted(ids)]), F.col("id") + 1)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` with values as text and missing as its own group."""
    return union_all(
        [
            counts.select(_named(ids).alias("column"), F.col("value").cast("string").alias("value"), "n")
            for ids, counts in typed_value_counts(df, columns)
        ],
        empty(df, "column string, value string, n bigint"),
    )


def long_text(df: DataFrame, columns: list[str]) -> list[str]:
    """The text columns with a value of more than ``HASHED_FROM`` bytes."""
    names = [c for c in columns if family(df.schema[c].dataType) == "text"]
    facts = column_facts(df, names, lambda c: {"most": F.max(F.octet_length(col(c)))}, buffers=1)
    return [c for c in names if (facts[c]["most"] or 0) > HASHED_FROM]


def _of_long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``distinct_and_mode`` of long text, which itself is never shuffled value by value.

    Values are counted under a 128-bit hash, beside their first characters.  These name,
    for each column, the highest count and the least beginning that has it; only values
    that begin so are then counted whole.
    """
    ids = dict(enumerate(columns))
    texts = df.select(*[col(c).cast("string").alias(str(i)) for i, c in ids.items()])

    def rows(frame):
        return frame.unpivot([], frame.columns, "id", "value").select(F.col("id").cast("int").alias("id"), "value")

    begins = F.substring("value", 1, HASHED_FROM)
    hashed = rows(texts).select("id", F.unhex(F.md5(F.col("value").cast("binary"))).alias("key"), begins.alias("begin"))
    counts = hashed.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("begin").alias("begin"))
    seen = F.col("key").isNotNull()
    facts = counts.groupBy("id").agg(
        F.count_if(seen).alias("distinct"), F.count(F.lit(1)).alias("distinct_all"), F.min(F.when(seen, F.struct((-F.col("n")).alias("rank"), "begin"))).alias("top")
    )
    facts = {r["id"]: r for r in facts.collect()}
    tops = {i: r["top"] for i, r in facts.items() if r["top"] is not None}
    best = {}
    if tops:
        like = texts.select(*[F.when(F.substring(str(i), 1, HASHED_FROM) == t["begin"], F.col(str(i))).alias(str(i)) for i, t in tops.items()])
        n = F.element_at(F.create_map(*[F.lit(x) for i, t in tops.items() for x in (i, -t["rank"])]), F.col("id"))
        whole = rows(like).where("value IS NOT NULL").groupBy("id", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
        best = dict(map(tuple, whole.groupBy("id").agg(F.min("value")).collect()))
    return df.sparkSession.createDataFrame(
        [
            (c, facts[i]["distinct"] if i in facts else 0, facts[i]["distinct_all"] if i in facts else 0, best.get(i), -tops[i]["rank"] if i in tops else 0)
            for i, c in ids.items()
            if i in facts
        ],
        "column string, distinct bigint, distinct_all bigint, top_value string, top_count bigint",
    )


def distinct_and_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, distinct, distinct_all, top_value, top_count)``.

    ``distinct_all`` counts missing as a value.  Ties go to the smallest value in
    the column's own order (numbers as numbers).  Distinct long texts are told apart
    by a 128-bit hash.
    """
    long_ = long_text(df, columns)
    parts = [_of_long_text(df, long_)] if long_ else []
    for ids, counts in typed_value_counts(df, [c for c in columns if c not in long_]):
        seen = F.col("value").isNotNull()
        parts.append(
            counts.groupBy("id")
            .agg(
                F.count_if(seen).alias("distinct"),
                F.count(F.lit(1)).alias("distinct_all"),
                F.min(F.when(seen, F.struct((-F.col("n")).alias("rank"), F.col("value")))).alias("top"),
            )
            .select(
                _named(ids).alias("column"),
                "distinct",
                "distinct_all",
                F.col("top.value").cast("string").alias("top_value"),
                F.coalesce(-F.col("top.rank"), F.lit(0)).alias("top_count"),
            )
        )
    return union_all(parts, empty(df, "column string, distinct bigint, distinct_all bigint, top_value string, top_count bigint"))


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Typed mode per column on the driver (one value per column)."""
    out: dict[str, object] = {c: None for c in columns}
    long_ = long_text(df, columns)
    if long_:
        out |= {r["column"]: r["top_value"] for r in _of_long_text(df, long_).collect()}
    for ids, counts in typed_value_counts(df, [c for c in columns if c not in long_]):
        top = (
            counts.where(F.col("value").isNotNull())
            .groupBy("id")
            .agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("top"))
        )
        for r in top.collect():
            out[ids[r["id"]]] = r["top"]["value"]
    return out


def duplicate_rows(df: DataFrame, rows: int | None = None) -> int:
    """Rows minus distinct rows, exactly.

    Rows are grouped by a 64-bit hash first, which shuffles eight bytes of each
    instead of the row; only rows whose hash repeats, which may be other rows of
    the same hash, are then grouped by value.
    """
    keys = [col(c) for c in groupable(df)]
    if not keys:
        return max(0, (df.count() if rows is None else rows) - 1)
    hashed = df.withColumn("__row_hash", F.xxhash64(*keys))
    repeated = hashed.groupBy("__row_hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__row_hash")
    per_row = hashed.join(repeated, "__row_hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_row.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("d")).first()["d"]


def groupable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def byte_size(df: DataFrame, name: str) -> Column:
    """Aggregate: bytes of a column's values (text by length, others by width)."""
    dtype = df.schema[name].dataType
    if family(dtype) == "text":
        return F.coalesce(F.sum(F.octet_length(col(name)).cast("bigint")), F.lit(0).cast("bigint"))
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(dtype.simpleString(), 8)
    return F.count(F.lit(1)) * F.lit(width)



def approx_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Estimated distinct values per column (5 % standard error)."""
    facts = column_facts(df, columns, lambda c: {"distinct": F.approx_count_distinct(col(c))})
    return {c: facts[c]["distinct"] for c in columns}


def with_distinct(df: DataFrame, columns: list[str], at_least: int) -> list[str]:
    """Columns with at least ``at_least`` distinct values, exactly.

    A sketch settles columns with plainly more; only the others are counted, and
    those have so few values that partial aggregation leaves almost no shuffle.
    """
    if not columns:
        return []
    guess = approx_distinct(df, columns)
    sure = {c for c in columns if guess[c] >= 10 * at_least}
    unsure = [c for c in columns if c not in sure]
    if unsure:
        exact = distinct_and_mode(df, unsure).where(F.col("distinct") >= at_least).select("column").collect()
        sure |= {r["column"] for r in exact}
    return [c for c in columns if c in sure]
