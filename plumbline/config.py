"""Thresholds, word lists and messages.

Every number an operator compares against is a field here, so a caller can
change it without touching the operator.  Word lists that say what a table is
about are empty here: the caller knows the table's vocabulary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Spellings that mean "no value" when a table is first loaded.
LOAD_TOKENS = (
    "", "NA", "N/A", "na", "n/a", "NULL", "null", "None", "NaN", "nan",
    "none", "missing", "unknown", "?", "-", "--",
)

# The same idea inside a cleaning run, where symbols at the edges
# have already been stripped.
CLEAN_TOKENS = (
    "", "NA", "N/A", "na", "n/a", "NULL", "null", "None", "NaN", "nan",
    "none", "missing", "unknown", "?", "-", "--",
)

# Words that mark a column as naming a thing, not measuring it.
IDENTIFIER_WORDS = (
    "id", "key", "uuid", "guid", "code", "serial", "sku", "barcode", "isbn",
    "ssn", "phone", "email", "zip", "postcode", "account", "token",
)

# Words that mark a numeric column as a whole-number quantity; the caller's to give.
INTEGER_WORDS: tuple[str, ...] = ()

# Words that exempt a numeric column from outlier capping.
UNCAPPED_WORDS = IDENTIFIER_WORDS + (
    "year", "month", "day", "lat", "latitude", "lon", "longitude", "flag",
    "label", "class", "target", "rank", "index",
)

# Words that exempt a text column from title casing.
CASE_SENSITIVE_WORDS = IDENTIFIER_WORDS + (
    "url", "path", "hash", "iban", "currency", "symbol", "version",
)

# Words that hint that a column is what people want to predict; the caller's to give.
TARGET_WORDS: tuple[str, ...] = ()

# Accepted date spellings, each with the shape it must have before
# a parse is tried (a failed parse is far dearer than a failed regex).  A time may
# have a fraction of a second and a zone; it is read as UTC.
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$", ""),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)

# How every text begins that fits one of these shapes.
DATE_START = r"^([0-9]{1,2}[-/ ]|[0-9]{4}[-/]|[A-Za-z]{3} )"

# The shortest and longest text that fits one of these shapes.
MIN_DATE_LENGTH, MAX_DATE_LENGTH = 8, 35

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Upper bounds on what may be collected or broadcast as a lookup.  Everything
# larger takes a shuffle instead.
LOOKUP_ROWS = 100_000
LOOKUP_BYTES = 16 << 20

# Up to this many non-missing values per column, Spark's one-pass exact
# percentile is used; beyond it, the selection in functions.quantiles.
IN_MEMORY_VALUES = 250_000


def name_words(name: str) -> list[str]:
    """Lower-case words of a column name, split on punctuation and case."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if w] or [name.lower()]


def name_matches(name: str, words: tuple[str, ...], substring: bool = False) -> bool:
    """Whole-word match by default; ``substring=True`` matches anywhere in the name."""
    if substring:
        low = name.lower()
        return any(w in low for w in words)
    found = {w.lower() for w in name_words(name)}
    return any(w in found for w in words)


@dataclass(frozen=True)
class ProfileOptions:
    identifier_words: tuple[str, ...] = IDENTIFIER_WORDS
    identifier_ratio: float = 0.98
    date_share: float = 0.80
    text_distinct: int = 50
    severity_high: float = 50.0
    severity_medium: float = 20.0
    fence_factor: float = 1.5
    min_values_for_fences: int = 5
    strong_correlation: float = 0.70
    outlier_warning_pct: float = 5.0
    small_rows: int = 100
    large_rows: int = 100_000
    numeric_saving: float = 0.35
    text_saving: float = 0.60
    text_saving_ratio: float = 0.40


# The weights, caps and limits of the classes below.


@dataclass(frozen=True)
class HealthByCount:
    """Score A: penalties on absolute counts."""

    per_missing_cell: float = 0.05
    missing_cap: float = 30.0
    per_duplicate: float = 2.0
    duplicate_cap: float = 20.0
    per_empty_column: float = 10.0
    per_constant_column: float = 5.0


@dataclass(frozen=True)
class HealthByShare:
    """Score B: penalties on shares."""

    per_missing_pct: float = 0.35
    missing_cap: float = 30.0
    per_duplicate_pct: float = 0.50
    duplicate_cap: float = 20.0
    per_constant_column: float = 2.0
    per_identifier_column: float = 1.0
    grades: tuple[tuple[float, str, str], ...] = (
        (90.0, "A", "very good"),
        (80.0, "B", "good"),
        (70.0, "C", "fair"),
        (60.0, "D", "weak"),
        (0.0, "F", "poor"),
    )
    readiness: tuple[tuple[float, str], ...] = (
        (90.0, "ready"),
        (75.0, "nearly ready"),
        (60.0, "needs cleaning"),
        (0.0, "not ready"),
    )


@dataclass(frozen=True)
class TargetRules:
    words: tuple[str, ...] = TARGET_WORDS
    word_points: int = 50
    few_text_points: int = 30
    two_valued_points: int = 40
    many_numeric_points: int = 20
    max_classes: int = 20
    keep_from: int = 30


@dataclass(frozen=True)
class AdviceRules:
    few_rows: int = 1_000
    many_rows: int = 50_000
    huge_rows: int = 200_000
    many_columns: int = 20
    good_health: float = 85.0
    fair_health: float = 70.0
    # Accuracy in percent that people tend to reach, by health score; a rule of thumb.
    expected: tuple[tuple[float, int, int], ...] = ((85.0, 90, 95), (70.0, 85, 90), (0.0, 70, 85))


@dataclass(frozen=True)
class CleanOptions:
    """Switches and thresholds of the full cleaning run; one switch per step."""

    standardize_names: bool = True
    clean_strings: bool = True
    null_tokens: bool = True
    numeric_strings: bool = True
    replace_infinite: bool = True
    clean_integers: bool = True
    drop_empty_rows: bool = True
    drop_duplicates: bool = True
    fill_numeric: bool = True
    cap_outliers: bool = True
    fill_text: bool = True
    restore_integers: bool = True
    title_case: bool = True
    drop_constant: bool = True
    drop_duplicate_columns: bool = True
    bool_to_int: bool = True
    convert_dates: bool = True
    drop_sparse: bool = False

    tokens: tuple[str, ...] = CLEAN_TOKENS
    numeric_share: float = 0.80
    date_share: float = 0.80
    sparse_share: float = 0.80
    fence_factor: float = 1.5
    min_distinct_for_cap: int = 5
    fallback_text: str = "Unknown"
    integer_words: tuple[str, ...] = INTEGER_WORDS
    uncapped_words: tuple[str, ...] = UNCAPPED_WORDS
    case_words: tuple[str, ...] = CASE_SENSITIVE_WORDS
    substring_names: bool = False


@dataclass(frozen=True)
class BasicCleanOptions:
    """The shorter cleaning run."""

    drop_duplicates: bool = True
    drop_constant: bool = True
    drop_identifiers: bool = False
    convert_dates: bool = True
    numeric_fill: str = "median"
    text_fill: str = "mode"
    fill_constant: str = "Unknown"
    date_share: float = 0.80
    profile: ProfileOptions = field(default_factory=ProfileOptions)
