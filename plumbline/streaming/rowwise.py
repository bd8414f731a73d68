"""Cleaning steps on a stream.

The engine is a batch engine.  Steps that look at one row at a time need no state,
so they run unchanged on a streaming DataFrame; steps that must first see the
table take decisions found on a batch instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.functions.schema import replace_columns
from plumbline.operators import clean


def clean_rows(stream: DataFrame, fills: dict | None = None, caps: dict | None = None) -> DataFrame:
    """Normalise missing text, strip symbols, drop infinities, then apply fills and
    caps that ``find_numeric_fills``, ``find_text_fills`` and ``find_caps`` returned
    for a batch of the same data."""
    out = clean.normalize_missing(stream)
    out = clean.clean_strings(out)
    out = clean.null_tokens(out)
    out = clean.replace_infinite(out)
    out = clean.apply_fills(out, fills or {})
    return replace_columns(out, {c: clean.capped(out, c, cap) for c, cap in (caps or {}).items()})
