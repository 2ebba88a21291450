"""Dashboard tables: KPIs, series, histograms and distributions over scored readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.labels import NOMINAL_VOLTAGE
from wattline.operators.ordered import arrange
from wattline.operators.quality import bin_index, long_form, numeric_columns
from wattline.operators.splits import latest
from wattline.sources.readings import ROW, TS

KWH = "consumption_kwh"
# Reference load and efficiency target of the KPI deltas.
BASE_LOAD, EFFICIENCY_TARGET = 200.0, 75.0


def _time_order(df: DataFrame) -> list[str]:
    return [c for c in (TS, ROW) if c in df.columns]


def overview(df: DataFrame, last: int = 168) -> DataFrame:
    """KPIs of the last ``last`` rows, with voltage figures of all rows."""
    whole = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("voltage").alias("avg_voltage"),
        F.stddev_samp("voltage").alias("voltage_deviation"),
    ).select(F.struct("*")).scalar()
    recent = latest(df, last).agg(
        F.sum(KWH).alias("total_consumption"), F.avg(KWH).alias("average_usage"), F.max(KWH).alias("peak_usage"),
        F.min(KWH).alias("min_usage"), F.sum("anomaly_flag").alias("anomaly_count"),
        F.count(F.lit(1)).alias("filtered_rows"),
    )
    accuracy = (1 - F.col("anomaly_count") / F.greatest(F.col("filtered_rows"), F.lit(1))) * 100
    shown = ["total_consumption", "average_usage", "peak_usage", "min_usage"]
    return recent.select(
        *[F.round(c, 2).alias(c) for c in shown], F.round(accuracy, 1).alias("data_accuracy"),
        "anomaly_count", "filtered_rows", whole["row_count"].alias("row_count"),
        F.round(whole["avg_voltage"], 1).alias("avg_voltage"),
        F.round(whole["voltage_deviation"], 2).alias("voltage_deviation"),
    )


def recent_series(df: DataFrame, last: int = 72) -> DataFrame:
    """Consumption and voltage of the last rows beside the nominal voltage."""
    return latest(df, last).select(
        F.date_format(TS, "yyyy-MM-dd HH:mm").alias("time"), F.round(KWH, 2).alias("value"),
        F.round(F.coalesce("voltage", F.lit(NOMINAL_VOLTAGE)), 2).alias("voltage"),
        F.lit(NOMINAL_VOLTAGE).alias("nominal"),
    )


def short_summary(df: DataFrame, last: int = 24) -> DataFrame:
    rows = df.agg(F.count(F.lit(1))).scalar()
    return latest(df, last).agg(
        F.round(F.sum(KWH), 2).alias("total_consumption_kwh"), F.round(F.avg(KWH), 2).alias("avg_consumption_kwh"),
        F.round(F.max(KWH), 2).alias("peak_kwh"),
    ).withColumn("records", rows)


def window_kpis(df: DataFrame) -> DataFrame:
    """KPI cards of an already filtered view, with their deltas."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("data_points"),
        F.sum(KWH).alias("total_kwh"),
        (F.try_divide(F.sum(KWH), rows) - BASE_LOAD).alias("vs_baseline"),
        F.avg(KWH).alias("avg_kwh"),
        F.stddev_samp(KWH).alias("sigma"),
        F.sum("anomaly_flag").alias("anomalies"),
        (F.try_divide(F.sum("anomaly_flag"), rows) * 100).alias("anomaly_pct"),
        (F.avg((F.col("health_status") == "critical").cast("int")) * 100).alias("critical_pct"),
        F.avg("efficiency_score").alias("avg_efficiency"),
        (F.avg("efficiency_score") - EFFICIENCY_TARGET).alias("vs_target"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))


def _with_empty_bins(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Keep every bin of a fixed list, counting zero where no row fell."""
    spark = counts.sparkSession
    bins = spark.createDataFrame(list(enumerate(labels)), "bin bigint, range string")
    return bins.join(counts, "bin", "left").select("bin", "range", F.coalesce("count", F.lit(0)).alias("count"))


def score_histogram(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Ten bins over 0..100, closed on the right; 0 belongs to the first."""
    scaled = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * 100
    place = F.greatest(F.ceil(scaled / 10) - 1, F.lit(0))
    counts = df.filter(F.col(score).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return _with_empty_bins(counts, [f"{10 * i}-{10 * i + 10}" for i in range(10)])


def urgency_histogram(df: DataFrame, urgency: str = "maintenance_urgency") -> DataFrame:
    """Five bins over 0..100, closed on the left; exactly 100 falls in none."""
    inside = df.filter((F.col(urgency) >= 0) & (F.col(urgency) < 100))
    counts = inside.groupBy(F.floor(F.col(urgency) / 20).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return _with_empty_bins(counts, [f"{20 * i}-{20 * i + 20}%" for i in range(5)])


def equal_width_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, count) between the column's own bounds; empty bins kept."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(F.struct("*")).scalar()
    place = bin_index(F.col(column), bounds["lo"], bounds["hi"], bins)
    counts = df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (bounds["hi"] - bounds["lo"]) / bins
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select(
        "bin", (bounds["lo"] + F.col("bin") * width).alias("low"),
        (bounds["lo"] + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def severity_summary(alerts: DataFrame) -> DataFrame:
    def of(level: str) -> Column:
        return F.count_if(F.col("severity") == level).alias(level)

    return alerts.agg(F.count(F.lit(1)).alias("total"), of("critical"), of("warning"), of("info"))


def feature_dispersion(df: DataFrame, first: int = 8) -> DataFrame:
    columns = [c for c in numeric_columns(df) if c not in ("is_anomaly", "anomaly_flag")][:first]
    wide = df.agg(*[F.round(F.stddev_samp(c), 3).alias(f"{c}__std") for c in columns])
    return long_form(wide, columns, ["std"], "feature").withColumn("feature", F.substring("feature", 1, 18))


def trend(df: DataFrame, column: str = KWH, least: int = 10) -> DataFrame:
    """Least-squares slope over the row number, divided by the mean; gaps count as the mean."""
    mean = df.agg(F.avg(column)).scalar()
    placed = arrange(df.select(column, *_time_order(df)), [], _time_order(df)).with_position("_p")
    placed = placed.withColumn("_y", F.coalesce(F.col(column), mean))
    return placed.agg(
        F.when(F.count(F.lit(1)) < least, F.lit(0.0)).otherwise(
            F.try_divide(F.try_divide(F.covar_pop("_y", "_p"), F.var_pop("_p")), F.avg(column) + F.lit(1e-8))).alias("trend"))


def upload_analytics(df: DataFrame) -> DataFrame:
    """Totals, validity and voltage spread of an uploaded table."""
    valid, rows = F.count(KWH), F.count(F.lit(1))
    return df.agg(
        F.round(F.coalesce(F.sum(KWH), F.lit(0.0)), 2).alias("total_consumption"),
        F.round(F.coalesce(F.avg(KWH), F.lit(0.0)), 2).alias("average_usage"),
        F.round(F.greatest(F.coalesce(F.max(KWH), F.lit(0.0)), F.lit(0.0)), 2).alias("peak_usage"),
        F.round(F.coalesce(F.min(KWH), F.lit(0.0)), 2).alias("min_usage"),
        F.round(F.coalesce(F.try_divide(valid, rows) * 100, F.lit(0.0)), 1).alias("data_accuracy"),
        (rows - valid).alias("invalid_rows"),
        rows.alias("row_count"),
        F.round(F.coalesce(F.avg("voltage"), F.lit(0.0)), 1).alias("avg_voltage"),
        F.round(F.coalesce(F.stddev_pop("voltage"), F.lit(0.0)), 1).alias("voltage_deviation"),
        F.min(TS).alias("first_time"),
        F.max(TS).alias("last_time"),
    )


def upper_median(df: DataFrame, column: str = KWH) -> DataFrame:
    """The value at rank n // 2 of the sorted values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    ranked = arrange(counts, [], ["v"]).running({"upto": ("sum", "n")})
    return ranked.filter(F.col("upto") > F.floor(rows / 2)).agg(F.min("v").alias("median"))


def efficiency_bands(df: DataFrame, column: str = KWH) -> DataFrame:
    """Counts of values below 0.6, 1 and 1.4 times the upper median, and above."""
    middle = upper_median(df, column).scalar()
    ratio = F.when(middle > 0, F.try_divide(F.col(column), middle)).otherwise(1.0)
    wide = df.filter(F.col(column).isNotNull()).agg(
        F.count_if(ratio < 0.6).alias("a"), F.count_if((ratio >= 0.6) & (ratio < 1.0)).alias("b"),
        F.count_if((ratio >= 1.0) & (ratio < 1.4)).alias("c"), F.count_if(ratio >= 1.4).alias("d"))
    names = {"a": "Very Eff.", "b": "Efficient", "c": "Moderate", "d": "Inefficient"}
    lines = F.array(*[F.struct(F.lit(n).alias("name"), F.col(k).alias("hours")) for k, n in names.items()])
    return wide.select(F.inline(lines))


def deviation_histogram(df: DataFrame, column: str = KWH) -> DataFrame:
    """Ten buckets of min(1, |v - mean| / max(3 sigma, 1))."""
    moments = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"), F.count(column).alias("n")).select(
        F.struct("*")).scalar()
    spread = F.when(moments["n"] > 1, moments["s"]).otherwise(1.0)
    score = F.least(F.lit(1.0), F.abs(F.col(column) - moments["m"]) / F.greatest(spread * 3, F.lit(1.0)))
    place = F.least(F.lit(9).cast("bigint"), F.floor(score * 10))
    counts = df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return _with_empty_bins(counts, [f"{i / 10:.1f}" for i in range(10)])


def simple_anomalies(df: DataFrame, column: str = KWH, cut: float = 2.0) -> DataFrame:
    moments = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).select(F.struct("*")).scalar()
    z = F.try_divide(F.col(column) - moments["m"], moments["s"])
    return df.withColumn("z", z).withColumn("is_anomaly", F.abs("z") > cut)


def health_mix(df: DataFrame, column: str = KWH) -> DataFrame:
    """Idle, healthy, warning and critical shares read off the deviation histogram."""
    rows = F.greatest(df.agg(F.count(F.lit(1))).scalar(), F.lit(1))

    def share(low: int, high: int) -> Column:
        return F.sum(F.when(F.col("bin").between(low, high), F.col("count")).otherwise(0)) / rows

    wide = deviation_histogram(df, column).agg(
        share(7, 9).alias("critical"), share(5, 6).alias("warning"), share(0, 1).alias("idle"))
    wide = wide.withColumn("healthy", F.greatest(F.lit(0.0), 1 - F.col("critical") - F.col("warning") - F.col("idle")))
    lines = F.array(*[
        F.struct(F.lit(n.title()).alias("name"), F.round(F.col(n) * 100).cast("bigint").alias("value"))
        for n in ("healthy", "warning", "critical", "idle")])
    return wide.select(F.inline(lines))


def run_stats(df: DataFrame, predictions: DataFrame) -> DataFrame:
    rows = predictions.agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumns({
        "columns": F.lit(len(df.columns)).cast("bigint"), "predictions": rows})


def volume_series(df: DataFrame, last: int = 48) -> DataFrame:
    return latest(df, last).select(
        F.date_format(TS, "yyyy-MM-dd HH:mm").alias("time"), F.round(KWH, 2).alias("value"))


def maintenance_counts(df: DataFrame, urgency: str = "maintenance_urgency") -> DataFrame:
    return df.agg(F.avg(urgency).alias("mean_urgency"), F.count_if(F.col(urgency) > 70).alias("high"),
                  F.count_if(F.col(urgency) > 85).alias("critical"))


def series_kpis(df: DataFrame, column: str = KWH) -> DataFrame:
    return df.agg(F.round(F.sum(column), 2).alias("total"), F.round(F.avg(column), 2).alias("avg"),
                  F.min(column).alias("min"), F.max(column).alias("max"))
