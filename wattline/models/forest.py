"""Isolation forest: bounded samples grow trees in parallel, every row is scored against all of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wattline.functions.labels import severity
from wattline.models.scaling import fill_zero
from wattline.operators.ordered import arrange, percent_rank_of_ties
from wattline.operators.quantile import quantiles
from wattline.operators.splits import hash_sample, scatter
from wattline.session import materialize
from wattline.sources.readings import ROW

_SCALE = 2**32
_EULER = 0.5772156649015329


def expected_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass
class ForestModel:
    """Trees as flat arrays, at most ``trees * (2 * sample - 1)`` nodes, with the calibrated levels."""

    features: list[str]
    nodes: pd.DataFrame
    sample: int
    offset: float = 0.0
    threshold: float = 0.0

    def packed(self) -> list[tuple]:
        out = []
        for _, tree in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            out.append(tuple(tree[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")))
        return out


def _grow(names: list[str], sample: int, seed: int):
    depth_limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        x = pdf.sort_values("_draw")[names].to_numpy(dtype=float)
        draw = np.random.default_rng([seed, tree])
        lines, todo = [], [(np.arange(len(x)), 0)]
        lines.append(None)
        places = [0]
        while todo:
            rows, depth = todo.pop()
            place = places.pop()
            part = x[rows]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
            if depth >= depth_limit or len(spread) == 0:
                lines[place] = (place, -1, 0.0, -1, -1, depth + float(expected_path(len(rows))), len(rows), depth)
                continue
            feature = int(draw.choice(spread))
            low, high = part[:, feature].min(), part[:, feature].max()
            cut = float(draw.uniform(low, high))
            below = part[:, feature] <= cut
            left, right = len(lines), len(lines) + 1
            lines += [None, None]
            lines[place] = (place, feature, cut, left, right, 0.0, len(rows), depth)
            todo += [(rows[below], depth + 1), (rows[~below], depth + 1)]
            places += [left, right]
        out = pd.DataFrame(lines, columns=["node", "feature", "cut", "left", "right", "length", "size", "depth"])
        out.insert(0, "tree", tree)
        return out
    return build


def _samples(df: DataFrame, names: list[str], trees: int, sample: int, key: str) -> DataFrame:
    """Rows per tree (``_tree``, ``_draw``): disjoint hash draws of a large table, repeated ones of a small table."""
    rows = df.count()
    wanted = trees * sample
    if rows >= wanted:
        share = min(1.0, 1.3 * wanted / rows)
        pool = df.filter(scatter(key) < F.lit(int(share * _SCALE)))
        drawn = pool.withColumns({
            "_tree": F.pmod(F.xxhash64(F.col(key), F.lit("tree")), F.lit(trees)), "_draw": F.xxhash64(F.col(key), F.lit("draw"))})
    else:
        share = min(1.0, 1.3 * sample / max(rows, 1))

        def drawn_by(tree: Column) -> Column:
            return F.pmod(F.xxhash64(F.col(key), tree), F.lit(_SCALE)) < F.lit(int(share * _SCALE))

        every = F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint"))
        drawn = df.withColumn("_tree", F.explode(F.filter(every, drawn_by)))
        drawn = drawn.withColumn("_draw", F.xxhash64(F.col(key), F.col("_tree")))
    place = F.row_number().over(Window.partitionBy("_tree").orderBy("_draw", key))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= sample).select("_tree", "_draw", *names)


def raw_score(model: ForestModel) -> Column:
    """2 ** (-mean path / expected path) of each row, higher for easier isolation."""
    trees = model.packed()
    size = max(2, model.sample)
    norm = float(expected_path(size))

    @pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        x = columns.to_numpy(dtype=float)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, length in trees:
            at = np.zeros(len(x), dtype=np.int64)
            moving = rows if feature[0] >= 0 else rows[:0]
            while len(moving):
                here = at[moving]
                below = x[moving, feature[here]] <= cut[here]
                at[moving] = np.where(below, left[here], right[here])
                moving = moving[feature[at[moving]] >= 0]
            total += length[at]
        return pd.Series(np.power(2.0, -total / len(trees) / norm))

    return score(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in model.features]))


def fit_forest(df: DataFrame, features: Sequence[str], trees: int = 200, sample: int = 256,
               contamination: float = 0.05, key: str = ROW, seed: int = 42) -> ForestModel:
    """Grow the trees and calibrate the threshold so that ``contamination`` of the rows is flagged.

    Splits are drawn between a node's own bounds, so scaling a column would change nothing.
    """
    names = list(features)
    filled = fill_zero(df.select(key, *names), names)
    used = min(sample, filled.limit(sample).count())
    schema = "tree bigint, node int, feature int, cut double, left int, right int, length double, size int, depth int"
    width = filled.sparkSession.sparkContext.defaultParallelism
    drawn = _samples(filled, names, trees, used, key).repartition(width, "_tree")
    nodes = drawn.groupBy("_tree").applyInPandas(_grow(names, used, seed), schema).toPandas()  # bounded by trees * sample
    model = ForestModel(names, nodes, used)
    scored = materialize(df.select(raw_score(model).alias("_s")), "forest-scores")  # read several times, scored once
    levels = quantiles(scored, {"high": ("_s", 1 - contamination)}).first()
    # score = -(decision) = raw + offset, where offset is the contamination quantile of -raw
    model.offset = -float(levels["high"])
    model.threshold = 0.0
    return model


def predict(model: ForestModel, df: DataFrame) -> DataFrame:
    """Add anomaly_score, anomaly_flag, anomaly_pct and anomaly_severity."""
    scored = df.withColumn("anomaly_score", raw_score(model) + F.lit(model.offset))
    scored = scored.withColumn("anomaly_flag", (F.col("anomaly_score") >= model.threshold).cast("int"))
    scored = materialize(scored, "forest-scored")
    ranked = percent_rank_of_ties(scored, "anomaly_score", "anomaly_pct")
    return ranked.withColumn("anomaly_severity", severity(F.col("anomaly_score")))


def flag_scores(df: DataFrame, score: str, contamination: float = 0.05) -> DataFrame:
    """Flag the top share of given scores, with their percentile and severity."""
    level = quantiles(df, {"q": (score, 1 - contamination)}).scalar()
    flagged = df.withColumn("anomaly_flag", (F.col(score) >= level).cast("int"))
    ranked = percent_rank_of_ties(flagged, score, "anomaly_pct")
    return ranked.withColumn("anomaly_severity", severity(F.col(score)))


def split_weights(model: ForestModel, df: DataFrame) -> DataFrame:
    """Share of each feature in the splits, a split counting rows / 2**depth; (feature, weight)."""
    splits = model.nodes[model.nodes["feature"] >= 0]
    weight = (splits["size"] / np.exp2(splits["depth"])).groupby(splits["feature"]).sum()
    total = float(weight.sum()) or 1.0
    rows = [(name, float(weight.get(i, 0.0)) / total) for i, name in enumerate(model.features)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def permuted(df: DataFrame, columns: Sequence[str], key: str = ROW, shuffle: Callable[[str], Column] | None = None) -> DataFrame:
    """One copy of the rows for each column, named by ``feature``, with the values of that column dealt anew.

    The n-th row by key gets the value of the n-th row by ``shuffle`` (a hash of key and column; ties go by key), so the
    result is the same on every run. Rows are numbered by range, and no task holds a long table.
    """
    shuffle = shuffle or (lambda name: F.xxhash64(F.col(key), F.lit(name)))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), shuffle(c).alias("_h"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = materialize(df.select(key, *columns, F.inline(cells)), "permuted")
    values = arrange(long.select("feature", "_h", key, "_v"), ["feature"], ["_h", key]).with_position("_n").select("feature", "_n", "_v")
    rows = arrange(long.drop("_h", "_v"), ["feature"], [key]).with_position("_n").join(values, ["feature", "_n"])
    return rows.select(key, "feature", *[F.when(F.col("feature") == c, F.col("_v")).otherwise(F.col(c).cast("double")).alias(c) for c in columns])


def permutation_importance(df: DataFrame, columns: Sequence[str], score: Column, key: str = ROW,
                           shuffle: Callable[[str], Column] | None = None) -> DataFrame:
    """(feature, importance): mean absolute change of ``score`` when the values of one column are dealt anew."""
    changed = permuted(df, columns, key, shuffle).select(key, "feature", score.alias("_s"))
    base = df.select(key, score.alias("_base"))
    return changed.join(base, key).groupBy("feature").agg(F.avg(F.abs(F.col("_s") - F.col("_base"))).alias("importance"))


def explain(model: ForestModel, df: DataFrame, rows: int = 200, key: str = ROW) -> DataFrame:
    """Mean score change when a feature is permuted, over a fixed sample of ``rows`` rows."""
    tried = materialize(fill_zero(hash_sample(df.select(key, *model.features), rows, key), model.features), "explained")
    mean = permutation_importance(tried, model.features, raw_score(model), key)
    return mean.orderBy(F.col("importance").desc(), "feature")
