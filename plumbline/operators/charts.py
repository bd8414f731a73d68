"""The data behind charts: counts, shares, bins, boxes, trends and fits.

Each operator returns the aggregate a chart draws, never the rows.  Point clouds
come from ``point_sample``, which is a top-k by hash and so bounded.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.counts import column_facts, empty, per_column, union_all, value_counts, with_distinct
from plumbline.functions.exprs import to_time
from plumbline.functions.moments import pair_moments
from plumbline.functions.quantiles import described
from plumbline.functions.schema import DATETIME, NUMERIC, TEXT, col, columns_of, nan_to_null
from plumbline.operators.profile import fences, outside
from plumbline.operators.roles import categorical_names

MISSING = "(missing)"


def category_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` with missing as its own group."""
    df = nan_to_null(df)
    columns = categorical_names(df) if columns is None else columns
    return value_counts(df, columns).withColumn("value", F.coalesce("value", F.lit(MISSING)))


def topk_categories(df: DataFrame, k: int = 15, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` largest groups per column, with their share of all rows and of the kept rows.

    Spark limits each task to ``k`` rows per column before the window's shuffle.
    """
    rows = df.count()
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = category_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    kept = Window.partitionBy("column")
    return top.select(
        "column",
        "value",
        "n",
        F.col("rank").cast("bigint").alias("rank"),
        F.round(F.col("n") * 100.0 / rows, 1).alias("share_pct"),
        F.round(F.col("n") * 100.0 / F.sum("n").over(kept), 1).alias("share_of_kept_pct"),
    )


def category_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of all rows per group, and which group leads its column."""
    rows = df.count()
    counts = category_counts(df, columns)
    # one row per column
    lead = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("r"), "value")).alias("lead"))
    return counts.join(F.broadcast(lead), "column").select(
        "column",
        "value",
        "n",
        F.round(F.col("n") * 100.0 / rows, 1).alias("share_pct"),
        (F.col("value") == F.col("lead.value")).alias("is_dominant"),
    )


def two_level_counts(df: DataFrame, a: str | None = None, b: str | None = None, limit: int = 200) -> DataFrame:
    """Counts by two columns, the first ``limit`` groups in key order (not by size)."""
    df = nan_to_null(df)
    if a is None or b is None:
        names = categorical_names(df)
        if len(names) < 2:
            return empty(df, "level_1 string, level_2 string, n bigint")
        a, b = names[:2]
    keys = [F.coalesce(col(c).cast("string"), F.lit(MISSING)).alias(n) for c, n in ((a, "level_1"), (b, "level_2"))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy("level_1", "level_2").limit(limit)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class of a target column."""
    rows = df.where(col(label).isNotNull())
    total = rows.count()
    return rows.groupBy(col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * 100.0 / total, 2).alias("share_pct")
    )


# --- trends ------------------------------------------------------------------


def daily_trend(df: DataFrame, date: str, measure: str, digits: int = 2) -> DataFrame:
    """Sum of a measure per calendar day; a day without values sums to 0."""
    df = nan_to_null(df).where(col(date).isNotNull())
    return df.groupBy(F.to_date(col(date)).alias("day")).agg(
        F.round(F.coalesce(F.sum(col(measure)), F.lit(0)).cast("double"), digits).alias("total")
    )


def trend_summary(trend: DataFrame, min_periods: int = 5) -> DataFrame:
    """Periods, total, mean, and the peak with its (first) day; empty below ``min_periods``."""
    peak = F.max(F.struct("total", (-F.unix_date("day")).alias("d")))
    return (
        trend.agg(
            F.count(F.lit(1)).alias("periods"),
            F.round(F.sum("total"), 2).alias("total_value"),
            F.round(F.avg("total"), 2).alias("mean_value"),
            peak.alias("peak"),
        )
        .where(F.col("periods") >= min_periods)
        .select(
            "periods",
            "total_value",
            "mean_value",
            F.col("peak.total").alias("peak_value"),
            F.date_from_unix_date(-F.col("peak.d")).alias("peak_day"),
        )
    )


def date_measures(df: DataFrame, share: float) -> dict[str, object]:
    """Date columns of a chart: typed ones, and text that parses in more than ``share`` of rows."""
    text = columns_of(df, TEXT)
    facts = column_facts(df, text, lambda c: {"rows": F.count(F.lit(1)), "parsed": F.count(to_time(col(c)))})
    out = {c: col(c) for c in columns_of(df, DATETIME)}
    out |= {c: to_time(col(c)) for c in text if facts[c]["parsed"] > share * facts[c]["rows"]}
    return out


def trend_lines(df: DataFrame, share: float = 0.5, measures: list[str] | None = None) -> DataFrame:
    """Daily sums of every numeric column along every date column.

    ``(date_column, measure, day, total)``; one aggregate per date column carries
    all measures.  Numeric columns are never read as dates.
    """
    df = nan_to_null(df)
    measures = columns_of(df, NUMERIC) if measures is None else measures
    parts = []
    for name, when in date_measures(df, share).items() if measures else ():
        sums = [F.round(F.coalesce(F.sum(col(m).cast("double")), F.lit(0.0)), 2).alias(m) for m in measures]
        daily = df.groupBy(F.to_date(when).alias("__day")).agg(*sums).where("__day is not null")
        parts.append(
            daily.unpivot(["__day"], [col(m) for m in measures], "measure", "total").select(
                F.lit(name).alias("date_column"), "measure", F.col("__day").alias("day"), "total"
            )
        )
    return union_all(parts, empty(df, "date_column string, measure string, day date, total double"))


def trend_summaries(df: DataFrame, share: float = 0.7, min_periods: int = 5) -> DataFrame:
    """``trend_summary`` for every line of ``trend_lines``."""
    lines = trend_lines(df, share)
    peak = F.max(F.struct("total", (-F.unix_date("day")).alias("d")))
    return (
        lines.groupBy("date_column", "measure")
        .agg(
            F.count(F.lit(1)).alias("periods"),
            F.round(F.sum("total"), 2).alias("total_value"),
            F.round(F.avg("total"), 2).alias("mean_value"),
            peak.alias("peak"),
        )
        .where(F.col("periods") >= min_periods)
        .withColumn("peak_value", F.col("peak.total"))
        .withColumn("peak_day", F.date_from_unix_date(-F.col("peak.d")))
        .drop("peak")
    )


# --- distributions -----------------------------------------------------------


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 30, min_distinct: int = 5) -> DataFrame:
    """Equal-width bins per numeric column, empty ones included, with mean and median.

    Bin numbers are computed per column, then all columns are counted in one job.
    """
    df = nan_to_null(df)
    columns = with_distinct(df, columns or columns_of(df, NUMERIC), min_distinct)
    if not columns:
        return empty(
            df,
            "column string, bin bigint, low double, high double, n bigint, mean double, median double, width double, total bigint",
        )
    facts = described(df, columns, [0.5])
    width = {c: (facts[c]["high"] - facts[c]["low"]) / bins for c in columns}
    place = [
        F.least(F.floor((col(c).cast("double") - facts[c]["low"]) / width[c]), F.lit(bins - 1)).alias(str(i))
        for i, c in enumerate(columns)
    ]
    counts = (
        df.select(*place)
        .unpivot([], [str(i) for i in range(len(columns))], "id", "bin")
        .where("bin is not null")
        .groupBy(F.col("id").cast("int").alias("id"), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.createDataFrame(
        [
            (i, c, b, facts[c]["low"] + b * width[c], facts[c]["low"] + (b + 1) * width[c], width[c], facts[c]["mean"], facts[c]["quantiles"][0], facts[c]["n"])
            for i, c in enumerate(columns)
            for b in range(bins)
        ],
        "id int, column string, bin bigint, low double, high double, width double, mean double, median double, total bigint",
    )
    return grid.join(counts, ["id", "bin"], "left").select(
        "column",
        "bin",
        F.round("low", 4).alias("low"),
        F.round("high", 4).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round("mean", 4).alias("mean"),
        F.round("median", 4).alias("median"),
        "width",
        "total",
    )


def histogram_bins(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> DataFrame:
    return histogram(df, columns, bins).drop("width", "total")


def density(df: DataFrame, columns: list[str] | None = None, bins: int = 30, min_distinct: int = 10) -> DataFrame:
    """Histogram heights as count per unit of width, and the same normalised to area 1."""
    return histogram(df, columns, bins, min_distinct).select(
        "column",
        "bin",
        "low",
        "high",
        F.round(F.col("n") / F.col("width"), 6).alias("density"),
        F.round(F.col("n") / F.col("width") / F.col("total"), 9).alias("probability_density"),
    )


def box_stats(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5, min_distinct: int = 5) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per numeric column."""
    df = nan_to_null(df)
    columns = with_distinct(df, columns or columns_of(df, NUMERIC), min_distinct)
    marks = fences(df, columns, factor)

    def measures(c):
        v, m = col(c).cast("double"), marks[c]
        out = {
            "q1": F.lit(m["q1"]),
            "median": F.lit(m["median"]),
            "q3": F.lit(m["q3"]),
            "lower_fence": F.lit(m["low"]),
            "upper_fence": F.lit(m["high"]),
            "whisker_low": F.min(F.when(~outside(c, m), v)),
            "whisker_high": F.max(F.when(~outside(c, m), v)),
        }
        return {**{k: F.round(e, 4) for k, e in out.items()}, "outliers": F.count_if(outside(c, m))}

    names = ("q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high")
    return per_column(df, columns, measures, none=", ".join(f"{k} double" for k in names) + ", outliers bigint")


def box_points(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """``(column, value)`` for every value outside its fences."""
    df = nan_to_null(df)
    columns = with_distinct(df, columns or columns_of(df, NUMERIC), 5)
    if not columns:
        return empty(df, "column string, value double")
    marks = fences(df, columns, factor)
    values = df.select(*[F.when(outside(c, marks[c]), col(c).cast("double")).alias(c) for c in columns])
    return values.unpivot([], [col(c) for c in columns], "column", "value").where("value is not null")


def violin_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median and quartiles; the outline is ``density``."""
    df = nan_to_null(df)
    columns = with_distinct(df, columns or columns_of(df, NUMERIC), 5)
    marks = fences(df, columns)
    return per_column(
        df,
        columns,
        lambda c: {
            "mean": F.round(F.avg(col(c).cast("double")), 4),
            **{k: F.round(F.lit(marks[c][k]), 4) for k in ("median", "q1", "q3")},
        },
        none="mean double, median double, q1 double, q3 double",
    )


def missing_bars(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    return per_column(df, df.columns, lambda c: {"missing": F.count_if(col(c).isNull())}, none="missing bigint").where("missing > 0")


# --- pairs -------------------------------------------------------------------


def pair_columns(df: DataFrame, at_most: int = 5, min_distinct: int = 6) -> list[str]:
    return with_distinct(df, columns_of(df, NUMERIC), min_distinct)[:at_most]


def scatter_ols(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Least-squares line and r for every pair of the first few numeric columns.

    Rows missing either side are skipped per pair; all pairs share their scans.
    """
    df = nan_to_null(df)
    pairs = list(combinations(columns or pair_columns(df), 2))
    rows = [(x, y, m.n, m.slope, m.intercept, m.r2, m.r) for (x, y), m in pair_moments(df, pairs).items()]
    fits = df.sparkSession.createDataFrame(
        rows, "x string, y string, n bigint, slope double, intercept double, r2 double, r double"
    )
    digits = {"slope": 6, "intercept": 4, "r2": 6, "r": 2}
    return fits.withColumns({c: F.round(c, k) for c, k in digits.items()})


def point_sample(df: DataFrame, key: str, columns: list[str], rows: int = 1000, seed: int = 42) -> DataFrame:
    """A repeatable sample of points: the ``rows`` smallest hashes of the key."""
    h = F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(h, col(key)).limit(rows).select(col(key), *[col(c) for c in columns])


def pair_plot_points(df: DataFrame, key: str, rows: int = 1000) -> DataFrame:
    """Points for a pair plot of the first numeric columns, when there are at least three."""
    df = nan_to_null(df)
    columns = [c for c in columns_of(df, NUMERIC) if c != key][:5]
    if len(columns) < 3:
        raise ValueError("a pair plot needs at least three numeric columns")
    return point_sample(df, key, columns, rows)
