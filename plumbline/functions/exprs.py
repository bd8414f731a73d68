"""Scalar expressions.  All are built-in Spark functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.config import DATE_FORMATS, MAX_DATE_LENGTH, MIN_DATE_LENGTH, NUMBER_PATTERN

SPACE = " \t\n\r\f\x0b"

# Drop symbols before the first letter or number, keeping a sign or point that
# belongs to a number.  Both patterns fail at once on text without edge symbols, and
# the tail starts only where a symbol run starts, so long runs cost linear time.
_HEAD = r"^(?![+-]?[.]?\p{N})[^\p{L}\p{N}]+?(?=[+-]?[.]?\p{N}|\p{L})"
_TAIL = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]+$"
_HEAD_ASCII = r"^[^A-Za-z0-9]+"
_TAIL_ASCII = r"(?<![^A-Za-z0-9])[^A-Za-z0-9]+$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def tokens_to_null(c: Column, tokens: tuple[str, ...]) -> Column:
    trimmed = strip(c)
    return F.when(~trimmed.isin(*tokens), trimmed)


def strip_symbols(c: Column, ascii_only: bool = False) -> Column:
    t = strip(c)
    if ascii_only:
        return F.regexp_replace(F.regexp_replace(t, _HEAD_ASCII, ""), _TAIL_ASCII, "")
    return F.regexp_replace(F.regexp_replace(t, _TAIL, ""), _HEAD, "")


def to_number(c: Column) -> Column:
    """Text to double; only plain decimal spellings count (no ``1d``, no ``inf``)."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def currency_to_number(c: Column, scale_suffix: bool = True) -> Column:
    """``$1,200`` to 1200.0.  A trailing K or M multiplies unless ``scale_suffix`` is off."""
    t = F.regexp_replace(strip(c), "[,₹$€ ]", "")
    if not scale_suffix:
        return to_number(F.regexp_replace(t, "[MK]", ""))
    factor = F.when(t.rlike("[Kk]$"), 1e3).when(t.rlike("[Mm]$"), 1e6).otherwise(1.0)
    return to_number(F.regexp_replace(t, "[KkMm]$", "")) * factor


def to_time(c: Column, formats: tuple[tuple[str, str], ...] = DATE_FORMATS) -> Column:
    """Text to ``timestamp_ntz`` by the first format whose shape fits; else NULL.

    An empty format is Spark's own reading of ISO times; a zone moves the time to
    the session's.
    """
    t = strip(c)
    read = lambda fmt: F.try_to_timestamp(t, F.lit(fmt)) if fmt else t.try_cast("timestamp")
    parsed = F.coalesce(*[F.when(t.rlike(shape), read(fmt)) for shape, fmt in formats])
    # no accepted spelling is shorter or longer, and the test is much cheaper than a regex
    return F.when(F.length(t).between(MIN_DATE_LENGTH, MAX_DATE_LENGTH), parsed).cast("timestamp_ntz")


def title_case(c: Column) -> Column:
    """Capitalise every run of letters: ``o'neil new-york`` to ``O'Neil New-York``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    # initcap starts words after spaces only, which is enough for letters and spaces
    return F.when(c.rlike(r"[^\p{L} ]"), by_run).otherwise(F.initcap(c))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent; 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), digits)


def fraction_of(c: Column) -> Column:
    """Distance of a number from the nearest whole number."""
    return F.abs(c - F.rint(c))


def epoch_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def ladder(c: Column, steps, default=None) -> Column:
    """``when`` ladder over ``(threshold, value)`` pairs, highest threshold first."""
    out = F
    for threshold, value in steps:
        out = out.when(c >= threshold, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out
