"""From raw columns to model inputs: codes, scales, target types and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.config import LOOKUP_BYTES, LOOKUP_ROWS
from plumbline.functions.counts import column_facts, value_counts
from plumbline.functions.exprs import currency_to_number, epoch_micros, to_number
from plumbline.functions.schema import DATETIME, NUMERIC, TEXT, col, columns_of, family, nan_to_null, replace_columns
from plumbline.session import bounded, materialize

MISSING = "(missing)"


def features_and_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """All columns but the target are features."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    return [c for c in df.columns if c != target], target


# --- label encoding ----------------------------------------------------------


def as_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def fit_codes(df: DataFrame, columns: list[str], small_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``(column, value, code, n)``: codes 0..k-1 in text order; missing is a category."""
    counts = value_counts(df, columns).select("column", F.coalesce("value", F.lit(MISSING)).alias("value"), "n")
    table, small = bounded(counts, small_rows)
    if small:
        order = Window.partitionBy("column").orderBy("value")
        return table.withColumn("code", (F.row_number().over(order) - 1).cast("bigint")).select("column", "value", "code", "n")
    return _codes_by_range(table)


def _codes_by_range(counts: DataFrame) -> DataFrame:
    """Dense codes for any number of values: rank inside each range, plus the ranges before it.

    The ranges are written once, so every later read agrees on them.
    """
    ranges = materialize(
        counts.repartitionByRange("column", "value").withColumn("__range", F.spark_partition_id()), "codes"
    )
    sizes = ranges.groupBy("column", "__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy("column").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per column and range
    starts = sizes.select("column", "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("column", "__range").orderBy("value")
    coded = (
        ranges.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["column", "__range"])
        .select("column", "value", (F.col("__start") + F.col("__rank")).alias("code"), "n")
    )
    return materialize(coded, "codes")


def encode(df: DataFrame, codes: DataFrame, columns: list[str], small_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Replace each column by its code; values without a code become NULL.

    One left join per column, so the input is read once however many there are.  A
    column with few codes is joined by broadcast, its size checked first; the
    others by shuffle, where adaptive execution splits the partitions of values
    that are frequent in ``df`` itself.
    """
    coded = codes.where(F.col("column").isin(*columns)).groupBy("column")
    facts = coded.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")).collect()
    small = {r["column"] for r in facts if r["n"] <= small_rows and r["bytes"] <= LOOKUP_BYTES}
    for c in columns:
        lookup = codes.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        keyed = df.withColumn("__value", as_category(col(c)))
        df = _take_code(keyed.join(F.broadcast(lookup) if c in small else lookup.hint("merge"), "__value", "left"), c)
    return df


def _take_code(df: DataFrame, name: str) -> DataFrame:
    columns = [c for c in df.columns if c not in ("__value", "__code")]
    return df.select(*[F.col("__code").alias(c) if c == name else col(c) for c in columns])


def label_encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    columns = columns_of(df, TEXT) if columns is None else columns
    order = df.columns
    return encode(df, fit_codes(df, columns), columns).select(*map(col, order))


def factorize_target(df: DataFrame, target: str) -> DataFrame:
    """Target values become codes in value order (row order does not exist in Spark)."""
    return label_encode(df.where(col(target).isNotNull()), [target])


def unseen_categories(df: DataFrame, codes: DataFrame, columns: list[str], list_up_to: int = 50) -> DataFrame:
    """``(column, value, n, allowed_count, allowed)``: values the codes do not know.

    Both sides are distinct values, so a frequent value is one row.  ``allowed``
    spells out the known values where a column has at most ``list_up_to`` of them;
    ``codes`` holds them all.
    """
    seen = value_counts(df, columns).select("column", F.coalesce("value", F.lit(MISSING)).alias("value"), "n")
    known = codes.groupBy("column").agg(F.count(F.lit(1)).alias("allowed_count"))
    few = known.where(F.col("allowed_count") <= list_up_to).select("column")
    listed = codes.join(F.broadcast(few), "column", "left_semi").groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("allowed")
    )
    # one row per column
    about = known.join(listed, "column", "left")
    return seen.join(codes.select("column", "value"), ["column", "value"], "left_anti").join(F.broadcast(about), "column", "left")


# --- scaling -----------------------------------------------------------------


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column."""
    facts = column_facts(
        df, columns, lambda c: {"mean": F.avg(col(c).cast("double")), "std": F.stddev_pop(col(c).cast("double"))}
    )
    return {c: (f["mean"] or 0.0, f["std"] or 0.0) for c, f in facts.items()}


def scaled(name: str, mean: float, std: float) -> Column:
    c = col(name).cast("double")
    return (c - mean) / std if std > 0 else F.when(c.isNotNull(), 0.0)


def standard_scale(df: DataFrame, columns: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Zero mean, unit population variance; a column without variance becomes 0."""
    df = nan_to_null(df)
    columns = columns_of(df, NUMERIC) if columns is None else columns
    stats = fit_scale(df, columns)
    new = {c: scaled(c, *stats[c]) for c in columns}
    if digits is not None:
        new = {c: F.round(e, digits) for c, e in new.items()}
    return replace_columns(df, new)


# --- problem type ------------------------------------------------------------


@dataclass(frozen=True)
class ProblemRules:
    max_classes: int = 20
    numeric_text_share: float = 0.90
    max_text_classes: int = 30
    max_text_ratio: float = 0.30


def problem_type(df: DataFrame, target: str, rules: ProblemRules = ProblemRules()) -> DataFrame:
    """``(target, problem_type, target_values, distinct)`` in one row, from one grouping.

    ``target_values`` says how the target enters a model: ``as_is``, ``parsed`` from
    text such as money, or ``codes``.
    """
    df = nan_to_null(df).where(col(target).isNotNull())
    counts = df.groupBy(col(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    is_text = family(df.schema[target].dataType) == TEXT
    parsed = currency_to_number(F.col("v")).isNotNull() if is_text else F.lit(False)
    facts = counts.agg(
        F.count(F.lit(1)).alias("distinct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(parsed, F.col("n"))), F.lit(0)).alias("parsed"),
    )
    d, rows = F.col("distinct"), F.col("rows")
    if is_text:
        numeric = F.col("parsed") > rules.numeric_text_share * rows
        wide = (d > rules.max_text_classes) | (d > rules.max_text_ratio * rows)
        kind = F.when(numeric | wide, "regression").otherwise("classification")
        values = F.when(numeric, "parsed").otherwise("codes")
    else:
        many = (d > rules.max_classes) & F.lit(family(df.schema[target].dataType) == NUMERIC)
        kind = F.when(many, "regression").otherwise("classification")
        values = F.when(many, "as_is").otherwise("codes")
    return facts.select(F.lit(target).alias("target"), kind.alias("problem_type"), values.alias("target_values"), "distinct")


# --- splitting ---------------------------------------------------------------


def split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` plus ``is_test``: exactly ``ceil(test_share * n)`` rows of each class.

    Rows are ordered by a hash of the unique ``key``; the test rows are those up to
    a cut hash per class.  The cut is found by counting hash prefixes, so no class,
    however large, is ever sorted in one task.  When a class has a single row the
    split ignores classes.
    """
    label_of = as_category(col(label))
    sizes = df.groupBy(label_of.alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    lonely = sizes.where("__n < 2").limit(1).count() > 0
    hashed = df.select(
        (F.lit("all") if lonely else label_of).alias("__class"), split_hash(key, seed).alias("__hash")
    )
    cuts, small = bounded(_cut_hashes(hashed, test_share))
    rows = df.withColumns({"__class": F.lit("all") if lonely else label_of, "__hash": split_hash(key, seed)})
    joined = rows.join(F.broadcast(cuts) if small else cuts, "__class", "left")
    return joined.withColumn("is_test", F.coalesce(F.col("__hash") <= F.col("__cut"), F.lit(False))).select(
        *map(col, df.columns), "is_test"
    )


def _cut_hashes(hashed: DataFrame, share: float, digits: int = 4) -> DataFrame:
    """``(__class, __cut)``: the hash of the last test row of each class."""
    sizes = hashed.groupBy("__class").agg(F.count(F.lit(1)).alias("n"))
    # A collected table is of unknown size to the planner, which would shuffle all rows by class to meet it.
    sent = lambda state, small: F.broadcast(state) if small else state
    small = False
    state = sizes.select("__class", F.ceil(F.col("n") * share).alias("__need"), F.lit("").alias("__prefix"))
    rows = hashed
    # Each round fixes four more hex digits of the cut: 65,536 counters per class.
    for start in (1, 1 + digits):
        prefix = F.substring("__hash", start, digits)
        counts = rows.groupBy("__class", prefix.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("__class").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
        state = (
            counts.withColumn("__upto", F.sum("n").over(upto))
            .join(sent(state, small), "__class")
            .where((F.col("__upto") >= F.col("__need")) & (F.col("__upto") - F.col("n") < F.col("__need")))
            .select(
                "__class",
                (F.col("__need") - (F.col("__upto") - F.col("n"))).alias("__need"),
                F.concat("__prefix", "__p").alias("__prefix"),
            )
        )
        state, small = bounded(state)
        done = F.substring("__hash", 1, start + digits - 1)
        fixed = state.select("__class", F.col("__prefix").alias("__fixed"))
        rows = hashed.join(sent(fixed, small), "__class").where(done == F.col("__fixed"))
    # What is left shares eight hex digits: one row in four billion.
    order = Window.partitionBy("__class").orderBy("__hash")
    return (
        rows.withColumn("__rank", F.row_number().over(order))
        .join(sent(state, small), "__class")
        .where("__rank = __need")
        .select("__class", F.col("__hash").alias("__cut"))
    )


# --- model inputs ------------------------------------------------------------


@dataclass
class Preparation:
    """Everything fitted on the training rows: codes of text, fills and scales of numbers."""

    features: list[str]
    text: list[str]
    dates: list[str]
    codes: DataFrame | None
    scale: dict[str, tuple[float, float]]


def fit_preparation(train: DataFrame, features: list[str]) -> Preparation:
    train = nan_to_null(train.select(*map(col, features)))
    text, dates = columns_of(train, TEXT), columns_of(train, DATETIME)
    codes = fit_codes(train, text) if text else None
    numbers = as_numbers(train, Preparation(features, text, dates, codes, {}))
    return Preparation(features, text, dates, codes, fit_scale(numbers, features))


def as_numbers(df: DataFrame, prep: Preparation) -> DataFrame:
    """Codes for text, microseconds for dates, 0 for anything not a finite number."""
    df = nan_to_null(df)
    if prep.text:
        df = encode(df, prep.codes, prep.text)
    new = {}
    for c in prep.features:
        if c in prep.dates:
            v = epoch_micros(col(c)).cast("double")
        elif family(df.schema[c].dataType) == TEXT:
            v = to_number(col(c))
        else:
            v = col(c).cast("double")
        new[c] = F.coalesce(F.when(F.abs(v) < float("inf"), v), F.lit(0.0))
    return replace_columns(df, new)


def model_input(df: DataFrame, prep: Preparation) -> DataFrame:
    """Features as scaled doubles under their own names; other columns untouched."""
    df = as_numbers(df, prep)
    return replace_columns(df, {c: scaled(c, *prep.scale[c]) for c in prep.features})
