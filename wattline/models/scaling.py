"""Standardising and assembling feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


@contextmanager
def held(df: DataFrame):
    """Keep a training table while an iterative fit reads it again and again."""
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def scaling_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; one row comes back to the driver."""
    row = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]).first()
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 1.0) for c in columns}


def standardise(df: DataFrame, scaling: dict[str, tuple[float, float]], prefix: str = "z_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": (F.col(c) - m) / s for c, (m, s) in scaling.items()})


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)
