"""Table search, typed sorting, paging and column-role inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.numbers import parse_number


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column, shown as text, contains ``text`` in any letter case."""
    wanted = F.lit(text.lower())
    hit = F.lit(False)
    for name in df.columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), wanted)
    return df.filter(hit)


def sort_typed(df: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Sort by number where the text is one, then by text; ``ties`` make the order total."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    number = F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    keys = [number.asc_nulls_last(), text.asc()] if ascending else [number.desc_nulls_last(), text.desc()]
    return df.orderBy(*keys, *ties)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    return df.offset(number * size).limit(size)


# Name fragments that reveal a column's role, in order of preference.
ROLE_HINTS = {
    "time": ["time", "timestamp", "date", "datetime", "hour", "period"],
    "consumption": ["consumption", "kwh", "energy", "usage", "power", "load", "demand", "reading", "value"],
    "voltage": ["voltage", "volt", "v_rms", "vrms"],
}


def guess_column(columns: Sequence[str], hints: Sequence[str]) -> str | None:
    plain = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in columns}
    return next((c for hint in hints for c in columns if hint in plain[c]), None)


def column_roles(df: DataFrame, order: Sequence[str], sample: int = 50) -> DataFrame:
    """(role, column, score): by name first, then the best numeric column of the first ``sample`` rows.

    The score is the share of readable numbers plus a tenth of the share of those not negative.
    """
    found = {role: guess_column(df.columns, hints) for role, hints in ROLE_HINTS.items()}
    others = [c for c in df.columns if c != found["time"]]
    head = df.orderBy(*order).limit(sample)
    made = []
    for c in others:
        number = parse_number(F.col(c).cast("string"))
        valid, positive = F.count(number), F.count_if(number >= 0)
        made.append((valid / F.greatest(F.count(F.lit(1)), F.lit(1)) + positive / F.greatest(valid, F.lit(1)) * 0.1).alias(c))
    scores = head.agg(*made).first().asDict() if others else {}
    ranked = sorted((c for c in others if (scores[c] or 0) >= 0.5), key=lambda c: -scores[c])
    if found["consumption"] is None and ranked:
        found["consumption"] = ranked[0]
    if found["voltage"] is None:
        found["voltage"] = next((c for c in ranked if c != found["consumption"] and "volt" in c.lower()), None)
    rows = [(role, column, scores.get(column)) for role, column in found.items()]
    return df.sparkSession.createDataFrame(rows, "role string, `column` string, score double")


def within_dates(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to the end of day ``end``; rows without a time always pass."""
    keep = F.lit(True)
    if start:
        keep = keep & (F.col(ts) >= F.to_timestamp(F.lit(start)))
    if end:
        keep = keep & (F.col(ts) < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp"))
    return df.filter(F.col(ts).isNull() | keep)


def trailing_days(df: DataFrame, days: int, flag: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before the newest row, optionally flagged ones only."""
    newest = df.agg(F.max(ts)).scalar()
    kept = df.filter(F.col(ts) >= newest - F.make_dt_interval(F.lit(days)))
    return kept.filter(F.col(flag) == 1) if flag else kept
