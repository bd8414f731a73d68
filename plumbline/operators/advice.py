"""Rules over profiling results: findings, warnings, plans, targets and model advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.config import AdviceRules, HealthByShare, ProfileOptions, TargetRules, name_words
from plumbline.functions.counts import distinct_and_mode, groupable
from plumbline.functions.exprs import ladder
from plumbline.functions.schema import BOOLEAN, NUMERIC, TEXT, columns_of, family, nan_to_null
from plumbline.operators import profile, roles

DEFAULT = ProfileOptions()


def _rule(when: Column, code: str, severity: str, message: str, affected: Column) -> Column:
    row = F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(message).alias("message"),
        affected.cast("bigint").alias("affected"),
    )
    return F.when(when, row)


def _fired(facts: DataFrame, rules: list[Column]) -> DataFrame:
    return facts.select(F.explode(F.array(*rules)).alias("f")).where("f is not null").select("f.*")


def findings(facts: DataFrame, options: ProfileOptions = DEFAULT, health: HealthByShare = HealthByShare()) -> DataFrame:
    """One row per rule that fires on the facts of a table."""
    f = F.col
    facts = facts.withColumn("health_score", profile.share_score(health))
    good, fair = health.grades[0][0], health.grades[2][0]
    zero = F.lit(0)
    return _fired(
        facts,
        [
            _rule(f("health_score") >= good, "health_good", "info", "The table is in good shape.", zero),
            _rule((f("health_score") < good) & (f("health_score") >= fair), "health_fair", "medium", "The table needs some cleaning.", zero),
            _rule(f("health_score") < fair, "health_poor", "high", "The table needs thorough cleaning.", zero),
            _rule(f("missing_cells") > 0, "missing_values", "medium", "Some cells have no value.", f("missing_cells")),
            _rule(f("duplicate_rows") > 0, "duplicate_rows", "medium", "Some rows repeat another row.", f("duplicate_rows")),
            _rule(f("empty_columns") > 0, "empty_columns", "high", "Some columns hold no value at all.", f("empty_columns")),
            _rule(f("constant_columns") > 0, "constant_columns", "low", "Some columns hold a single value.", f("constant_columns")),
            _rule(f("identifier_columns") > 0, "identifier_columns", "low", "Some columns only name rows.", f("identifier_columns")),
            _rule(f("numeric_columns") == 0, "no_numeric_columns", "medium", "There is no numeric column.", zero),
            _rule(f("text_columns") > f("numeric_columns"), "mostly_text", "info", "Text columns outnumber numeric ones.", f("text_columns")),
            _rule(f("rows") < options.small_rows, "small_table", "medium", "There are few rows to learn from.", f("rows")),
            _rule(f("rows") > options.large_rows, "large_table", "info", "The table is large.", f("rows")),
        ],
    )


def quality_warnings(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """``(warning, column, value)``: duplicates, gaps, constants, identifiers, outliers."""
    none = F.lit(None).cast("string")

    def pick(source, warning, column, value):
        return source.select(F.lit(warning).alias("warning"), column.alias("column"), value.cast("double").alias("value"))

    name = F.col("column")
    return (
        pick(profile.duplicate_analysis(df).where("duplicate_rows > 0"), "duplicate_rows", none, F.col("duplicate_rows"))
        .unionByName(pick(profile.missing_analysis(df, options).where("severity = 'high'"), "mostly_missing", name, F.col("missing_pct")))
        .unionByName(pick(roles.constant_columns(df), "constant", name, F.lit(1)))
        .unionByName(pick(roles.identifier_columns(df, options), "identifier", name, F.col("distinct_pct")))
        .unionByName(
            pick(
                profile.iqr_outliers(df, options=options).where(F.col("outlier_pct") >= options.outlier_warning_pct),
                "outliers",
                name,
                F.col("outlier_pct"),
            )
        )
    )


def table_counts(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """Facts plus counts of columns by finding, as one row."""
    facts = profile.dataset_facts(df, options).first().asDict()
    outliers = profile.iqr_outliers(df, options=options).agg(
        F.count_if(F.col("outliers") > 0).alias("columns"), F.coalesce(F.sum("outliers"), F.lit(0)).alias("values")
    )
    o = outliers.first()
    dates = roles.datetime_columns(df, options.date_share).count()
    missing = profile.missing_analysis(df, options).count()
    row = {**facts, "outlier_columns": o["columns"], "outlier_values": o["values"], "date_like_columns": dates, "missing_columns": missing}
    schema = ", ".join(f"{k} {'double' if k.endswith('pct') else 'bigint'}" for k in row)
    return df.sparkSession.createDataFrame([tuple(row.values())], schema)


def cleaning_plan(counts: DataFrame) -> DataFrame:
    """Five ordered steps, each with whether it is needed and how much it touches."""
    steps = [
        ("remove duplicate rows", "duplicate_rows"),
        ("drop constant columns", "constant_columns"),
        ("drop identifier columns", "identifier_columns"),
        ("fill missing values", "missing_cells"),
        ("cap outliers", "outlier_values"),
    ]
    rows = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("position"),
            F.lit(step).alias("step"),
            (F.col(c) > 0).alias("enabled"),
            F.col(c).cast("bigint").alias("affected"),
        )
        for i, (step, c) in enumerate(steps)
    ]
    return counts.select(F.inline(F.array(*rows)))


def processing_log(counts: DataFrame) -> DataFrame:
    """``(category, n)`` in long form."""
    names = [
        "rows", "columns", "missing_cells", "missing_columns", "duplicate_rows", "constant_columns",
        "identifier_columns", "date_like_columns", "outlier_columns",
    ]
    return counts.unpivot([], names, "category", "n")


def feature_suggestions(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """``(column, suggestion)`` from roles, identifiers and outliers."""
    by_role = {
        "datetime": "split into calendar parts",
        "categorical": "encode as codes",
        "text": "derive length or keywords",
        "boolean": "use as 0 and 1",
        "numeric": "scale",
    }
    role = F.col("role")
    say = F
    for name, words in by_role.items():
        say = say.when(role == name, F.lit(words))
    out = roles.feature_types(df, options).select("column", say.otherwise(F.lit(None)).alias("suggestion"))
    ids = roles.identifier_columns(df, options).select("column", F.lit("leave out of models").alias("suggestion"))
    far = profile.iqr_outliers(df, options=options).where("outliers > 0").select(
        "column", F.lit("cap or transform outliers").alias("suggestion")
    )
    return out.unionByName(ids).unionByName(far)


def target_candidates(df: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """Columns worth predicting: ``(column, score, distinct, problem_type, rank)``.

    A column whose values are all distinct is never a candidate.  Names add points
    only by ``rules.words``, of which none are built in: a caller who knows what the
    table is about gives them.
    """
    df = nan_to_null(df)
    names = [c for c in groupable(df) if c in columns_of(df, NUMERIC, TEXT, BOOLEAN)]
    rows = df.count()
    meta = df.sparkSession.createDataFrame(
        [
            (c, family(df.schema[c].dataType), sum(w in name_words(c) for w in rules.words) * rules.word_points)
            for c in names
        ],
        "column string, kind string, word_points int",
    )
    d, kind = F.col("distinct"), F.col("kind")
    score = (
        F.col("word_points")
        + F.when((kind == TEXT) & d.between(2, rules.max_classes), rules.few_text_points).otherwise(0)
        + F.when((kind != TEXT) & (d == 2), rules.two_valued_points).otherwise(0)
        + F.when((kind == NUMERIC) & (d > rules.max_classes), rules.many_numeric_points).otherwise(0)
    )
    scored = (
        distinct_and_mode(df, names)
        .join(F.broadcast(meta), "column")
        .where(d < rows)
        .select(
            "column",
            score.cast("bigint").alias("score"),
            "distinct",
            F.when(d > rules.max_classes, "regression").otherwise("classification").alias("problem_type"),
        )
        .where(F.col("score") >= rules.keep_from)
    )
    return scored.orderBy(F.desc("score"), "column")


def model_suggestion(df: DataFrame, advice: AdviceRules = AdviceRules(), rules: TargetRules = TargetRules()) -> DataFrame:
    """One row of advice: task, model families, difficulty and confidence.

    The confidence and the expected accuracy are rules of thumb on the health score,
    not measurements.
    """
    best = target_candidates(df, rules).first()
    facts = profile.dataset_facts(df).withColumn("health_score", profile.share_score())
    task = best["problem_type"] if best else None
    rows, columns, health = F.col("rows"), F.col("columns"), F.col("health_score")
    linear = {"classification": "logistic regression", "regression": "linear regression"}.get(task, "clustering")
    family_name = (
        F.when(F.lit(task).isNull(), "choose a target first")
        .when(rows < advice.few_rows, f"{linear}, decision tree")
        .when((rows > advice.many_rows) | (columns > advice.many_columns), "gradient boosting, random forest")
        .otherwise(f"random forest, gradient boosting, {linear}")
    )
    return facts.select(
        F.lit(best["column"] if best else None).cast("string").alias("target"),
        F.lit(task).cast("string").alias("problem_type"),
        family_name.alias("model_families"),
        F.when(rows > advice.huge_rows, "hard").when(rows > advice.many_rows, "moderate").otherwise("easy").alias("difficulty"),
        ladder(health, [(advice.good_health, "high"), (advice.fair_health, "medium")], "low").alias("confidence"),
        ladder(health, [(t, low) for t, low, _ in advice.expected]).alias("expected_low_pct"),
        ladder(health, [(t, high) for t, _, high in advice.expected]).alias("expected_high_pct"),
        (F.col("text_columns") > F.col("numeric_columns")).alias("mostly_text"),
    )



def training_tips(facts: DataFrame, advice: AdviceRules = AdviceRules()) -> DataFrame:
    """What to do before training, one row per tip that applies to the facts of a table."""
    f = F.col
    return _fired(
        facts,
        [
            _rule(f("missing_cells") > 0, "fill_gaps", "medium", "Fill missing values before training.", f("missing_cells")),
            _rule(f("duplicate_rows") > 0, "drop_copies", "medium", "Drop repeated rows, or they leak into the test set.", f("duplicate_rows")),
            _rule(f("constant_columns") > 0, "drop_constants", "low", "Drop columns that never change.", f("constant_columns")),
            _rule(f("identifier_columns") > 0, "drop_identifiers", "medium", "Leave identifiers out of the features.", f("identifier_columns")),
            _rule(f("text_columns") > 0, "encode_text", "info", "Encode text columns as codes.", f("text_columns")),
            _rule(f("rows") < advice.few_rows, "cross_validate", "medium", "With few rows, prefer simple models and cross-validation.", f("rows")),
            _rule(f("rows") > advice.many_rows, "sample_first", "info", "Try settings on a sample first.", f("rows")),
        ],
    )
