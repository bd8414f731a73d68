"""The narrowest type that keeps every value of a text column.

Types are a lattice: int < bigint < decimal < text and int < double < text, with
flags and times beside the numbers.  One aggregate, whose parts merge in any order,
finds for every column how its values are spelled; their join is the type.  A type
that would change a value is never taken: a number of more digits than a double
keeps becomes a decimal, and beyond 38 digits it stays text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.config import DATE_START, NUMBER_PATTERN
from plumbline.functions.exprs import strip, to_number, to_time
from plumbline.functions.schema import TEXT, col, columns_of, replace_columns

#: Digits that a double always keeps, that it may keep, and that a decimal holds.
SURE_DIGITS, MOST_DIGITS, DECIMAL_DIGITS = 15, 17, 38
#: Columns measured by one aggregate.
CHUNK = 20

_WHOLE = r"^[+-]?[0-9]+$"


def _digits(text: Column) -> Column:
    """How many significant digits a number has before its exponent."""
    mantissa = F.regexp_replace(text, "[eE].*$", "")
    return F.length(F.ltrim(F.regexp_replace(mantissa, "[^0-9]", ""), F.lit("0")))


def _facts(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` and, of each value of the columns ``names``, what several measures use, found once."""
    fact = lambda k, i: F.col(f"__{k}{i}")

    def beside(df: DataFrame, k: str, of: Callable[[int], Column]) -> DataFrame:
        return df.withColumns({f"__{k}{i}": of(i) for i in range(len(names))})

    def sized(i: int, whole: Column, other: Column) -> Column:
        return F.when(fact("number", i).isNotNull(), F.when(fact("whole", i), whole).otherwise(other))

    # a whole number has no more than a sign and zeros before its digits
    plain = lambda i: F.length(F.ltrim(fact("text", i), F.lit("+-0")))
    df = beside(df, "text", lambda i: strip(col(names[i])))
    df = beside(df, "number", lambda i: F.when(fact("text", i).rlike(NUMBER_PATTERN), fact("text", i).try_cast("double")))
    df = beside(df, "whole", lambda i: fact("text", i).rlike(_WHOLE))
    df = beside(df, "digits", lambda i: sized(i, plain(i), _digits(fact("text", i))))
    df = beside(df, "before", lambda i: sized(i, plain(i), F.length(F.regexp_extract(fact("text", i), r"^[+-]?0*([0-9]*)", 1))))
    df = beside(df, "after", lambda i: sized(i, F.lit(0), F.length(F.regexp_extract(fact("text", i), r"\.([0-9]*)", 1))))
    return beside(
        df, "exact", lambda i: F.when(fact("whole", i) & (fact("digits", i) <= DECIMAL_DIGITS), fact("text", i).try_cast("decimal(38,0)"))
    )


def _measures(i: int) -> dict[str, Column]:
    """Over the facts of the column numbered ``i``."""
    text, number, whole, digits, before, after, exact = (F.col(f"__{k}{i}") for k in ("text", "number", "whole", "digits", "before", "after", "exact"))
    # A double of 16 or 17 digits is kept where writing it out gives the same number.
    same = number.cast("string").try_cast("decimal(38,18)") == text.try_cast("decimal(38,18)")
    kept = (digits <= SURE_DIGITS) | ((digits <= MOST_DIGITS) & (after <= 18) & F.coalesce(same, F.lit(False)))
    return {
        "present": F.count(text),
        "whole": F.count_if(whole),
        "exact": F.count(exact),
        "least": F.min(exact),
        "most": F.max(exact),
        "zeros": F.count_if(text.rlike("^[+-]?0[0-9]")),
        "number": F.count(number),
        "changed": F.count_if(number.isNotNull() & ~kept),
        "powers": F.count_if(number.isNotNull() & text.rlike("[eE]")),
        "before": F.max(before),
        "after": F.max(after),
        # the length tells most values apart, and costs less than lower case or ten shapes
        "flag": F.count_if(F.length(text).between(4, 5) & F.lower(text).isin("true", "false")),
        "time": F.count(F.when(text.rlike(DATE_START), to_time(text))),
    }


def join_of(f: dict, keep_zeros: bool) -> str | None:
    """The type for a column of such facts; None for text."""
    n = f["present"]
    if not n:
        return None
    if f["number"] == n and not (keep_zeros and f["zeros"]):
        if f["whole"] == n:
            if f["exact"] < n:
                return None
            for name, bits in (("int", 31), ("bigint", 63)):
                if -(1 << bits) <= f["least"] and f["most"] < 1 << bits:
                    return name
            return f"decimal({DECIMAL_DIGITS},0)"
        if not f["changed"]:
            return "double"
        before, after = max(1, f["before"]), f["after"]
        return None if f["powers"] or before + after > DECIMAL_DIGITS else f"decimal({before + after},{after})"
    if f["flag"] == n:
        return "boolean"
    return "timestamp_ntz" if f["time"] == n else None


def types_by_content(df: DataFrame, keep_zeros: bool = True, also: dict[str, Column] | None = None) -> tuple[dict[str, str], dict]:
    """Column -> type for the text columns that fit a narrower one, and the aggregates of ``also``, in the same pass.

    With ``keep_zeros`` a column with a whole number that starts with a zero stays text:
    007 and 7 are two codes.  Missing values fit every type; a column without a value,
    or a table without rows, stays text.
    """
    names, types, extra = columns_of(df, TEXT), {}, {}
    for at in range(0, max(1, len(names)), CHUNK):
        part = names[at : at + CHUNK]
        measures = [_measures(i) for i in range(len(part))]
        wanted = [m.alias(f"{k}{i}") for i, ms in enumerate(measures) for k, m in ms.items()]
        others = {} if at else also or {}
        if not wanted and not others:
            break
        row = _facts(df, part).agg(*wanted, *[e.alias(f"also_{k}") for k, e in others.items()]).first()
        extra |= {k: row[f"also_{k}"] for k in others}
        for i, c in enumerate(part):
            found = join_of({k: row[f"{k}{i}"] for k in measures[i]}, keep_zeros)
            if found:
                types[c] = found
    return types, extra


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The text columns of ``types`` as those types; every value fits."""
    read = {"double": to_number, "boolean": lambda c: F.lower(strip(c)) == "true", "timestamp_ntz": to_time}
    return replace_columns(df, {c: read[t](col(c)) if t in read else strip(col(c)).cast(t) for c, t in types.items()})
