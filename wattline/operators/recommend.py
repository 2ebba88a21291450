"""Recommendations and dataset-level alerts: one row of statistics against rule templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators import readmodels
from wattline.operators.rules import _text, fixed

KWH = "consumption_kwh"
# Order of priorities.
PRIORITIES = ("critical", "high", "medium", "info")


def recommendation_statistics(df: DataFrame) -> DataFrame:
    """The figures the templates refer to; absent inputs take neutral values."""
    has = set(df.columns).__contains__
    peak = F.avg("is_peak_hour") if has("is_peak_hour") else F.lit(0.0)
    anomalous = F.avg("anomaly_flag") if has("anomaly_flag") else F.lit(0.0)
    efficiency = F.avg("efficiency_score") if has("efficiency_score") else F.lit(80.0)
    critical = F.avg((F.col("health_status") == "critical").cast("int")) if has("health_status") else F.lit(0.0)
    slope = readmodels.trend(df).scalar()
    one = df.agg(
        peak.alias("peak_hour_ratio"), anomalous.alias("anomaly_rate"),
        (F.stddev_samp("voltage") if has("voltage") else F.lit(0.0)).alias("voltage_std"),
        efficiency.alias("avg_efficiency_score"), critical.alias("critical_share"),
        F.avg(KWH).alias("avg_consumption"), (F.sum(KWH) * 0.15).alias("savings"),
    )
    return one.select(
        "peak_hour_ratio", (F.col("peak_hour_ratio") * 100).alias("peak_pct"), "anomaly_rate",
        (F.col("anomaly_rate") * 100).alias("anomaly_pct"), "voltage_std", "avg_efficiency_score",
        F.col("avg_efficiency_score").alias("avg_eff"), F.col("critical_share").alias("critical_pct"),
        slope.alias("consumption_trend"), (slope * 100).alias("trend_pct"), "avg_consumption",
        F.col("avg_consumption").alias("avg_kwh"), (F.col("avg_consumption") / 4).alias("solar_kw"), "savings",
    )


def _line(condition: Column, **cells) -> Column:
    made = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in cells.items()]
    return F.when(condition, F.struct(*made))


def _fired(one_row: DataFrame, lines: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array_compact(F.array(*lines))))


def by_priority(recommendations: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return recommendations.orderBy(F.when(place > 0, place).otherwise(99), "id")


def recommendations(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """(id, priority, category, recommendation) for every template whose condition holds."""
    # Trigger levels and texts of the templates.
    level = {"peak": 0.6, "anomaly": 0.05, "voltage": 5.0, "efficiency": 65.0, "critical": 0.1, "trend": 0.05,
             "solar": 200.0, **(limits or {})}
    c = F.col
    lines = [
        _line(c("peak_hour_ratio") > level["peak"], id="load_shifting", priority="high", category="Load Management",
              recommendation=_text("Shift ", fixed(c("peak_pct"), 0), "% of peak-hour load to off-peak hours (10pm–6am) "
                                   "to reduce demand charges by an estimated ", fixed(c("savings"), 0), " kWh/month.")),
        _line(c("anomaly_rate") > level["anomaly"], id="anomaly_pattern", priority="critical", category="Equipment",
              recommendation=_text("Anomaly rate is ", fixed(c("anomaly_pct"), 1), "% — inspect equipment in zones with "
                                   "repeated spikes. Likely causes: motor inefficiency, HVAC fault, or power quality issues.")),
        _line(c("voltage_std") > level["voltage"], id="voltage_optimization", priority="medium", category="Power Quality",
              recommendation=_text("Voltage fluctuation (±", fixed(c("voltage_std"), 1), "V) detected. Install automatic voltage "
                                   "regulators (AVR) to reduce stress on appliances and improve power factor.")),
        _line(c("avg_efficiency_score") < level["efficiency"], id="efficiency_improvement", priority="high",
              category="Equipment Upgrade",
              recommendation=_text("Average efficiency score is ", fixed(c("avg_eff"), 0), "/100. Consider upgrading motors and "
                                   "compressors to IE3/IE4 class. Estimated energy savings: 15–25%.")),
        _line(c("critical_pct") > level["critical"], id="maintenance_schedule", priority="critical", category="Maintenance",
              recommendation=_text(fixed(c("critical_pct") * 100, 0), "% of operating hours show critical equipment signals. "
                                   "Schedule preventive maintenance within 72 hours to avoid unplanned downtime.")),
        _line(c("consumption_trend") > level["trend"], id="consumption_baseline", priority="medium",
              category="Energy Management",
              recommendation=_text("Consumption trend shows +", fixed(c("trend_pct"), 1), "% increase over baseline. Review HVAC "
                                   "setpoints and building insulation. Consider ISO 50001 energy audit.")),
        _line(c("avg_consumption") > level["solar"], id="renewable_potential", priority="info", category="Renewable Energy",
              recommendation=_text("Average consumption of ", fixed(c("avg_kwh"), 0), " kWh/day indicates strong ROI for rooftop "
                                   "solar (≈", fixed(c("solar_kw"), 0), " kW system). Estimated payback: 4–6 years.")),
    ]
    return by_priority(_fired(recommendation_statistics(df), lines))


def _dataset_figures(df: DataFrame) -> DataFrame:
    """Upload analytics with the counts of far values and inefficient readings, as one row."""
    far = readmodels.deviation_histogram(df).agg(F.sum(F.when(F.col("bin") >= 7, F.col("count")).otherwise(0))).scalar()
    wasteful = readmodels.efficiency_bands(df).agg(
        F.sum(F.when(F.col("name") == "Inefficient", F.col("hours")).otherwise(0))).scalar()
    return readmodels.upload_analytics(df).withColumns({"far": far, "wasteful": wasteful})


def dataset_alerts(df: DataFrame) -> DataFrame:
    """Alerts on a whole uploaded table: spikes, validity, voltage, anomaly rate, inefficiency."""
    c = F.col
    ratio = F.try_divide(c("peak_usage"), c("average_usage"))
    # Rules, limits, severities and texts.
    lines = [
        _line(ratio > 2, severity="critical", rule="Peak Spike Detected",
              message=_text("Peak usage ", fixed(c("peak_usage"), 1), " kWh is ", fixed(ratio, 1), "x above average.")),
        _line(c("invalid_rows") > 0, severity="warning", rule="Data Quality Issue",
              message=_text(c("invalid_rows").cast("string"), " invalid rows found during parsing. Check data integrity.")),
        _line(c("voltage_deviation") > 5, severity="critical", rule="Voltage Instability",
              message=_text("Voltage deviation of ±", fixed(c("voltage_deviation"), 1), "V exceeds safe threshold.")),
        _line((c("avg_voltage") > 0) & (F.abs(c("avg_voltage") - 230) > 10), severity="warning", rule="Voltage Deviation",
              message=_text("Average voltage ", fixed(c("avg_voltage"), 1), "V deviates ",
                            fixed(F.abs(c("avg_voltage") - 230), 1), "V from nominal 230V.")),
        _line(c("far") > c("row_count") * 0.05, severity="critical", rule="High Anomaly Rate",
              message=_text(c("far").cast("string"), " readings (", fixed(F.try_divide(c("far"), c("row_count")) * 100, 1),
                            "%) flagged as anomalous.")),
        _line(c("data_accuracy") < 95, severity="warning", rule="Low Data Accuracy",
              message=_text("Data accuracy at ", fixed(c("data_accuracy"), 1), "%. Consider cleaning the dataset.")),
        _line(ratio > 1.5, severity="info", rule="Load Optimization",
              message=_text("Peak-to-average ratio is ", fixed(ratio, 1), "x. Consider load shifting.")),
        _line(c("wasteful") > c("row_count") * 0.15, severity="warning", rule="Inefficiency Detected",
              message=_text(c("wasteful").cast("string"), " readings classified as inefficient.")),
    ]
    return _fired(_dataset_figures(df), lines)


def dataset_recommendations(df: DataFrame) -> DataFrame:
    c = F.col
    rate = c("far") / F.greatest(c("row_count"), F.lit(1)) * 100
    ratio = F.try_divide(c("peak_usage"), c("average_usage"))
    score = F.round(c("average_usage") / F.greatest(c("peak_usage"), F.lit(1.0)) * 100)
    # Limits, priorities, categories and texts.
    lines = [
        _line(rate > 3, priority="critical", category="Equipment",
              text=_text("Anomaly rate is ", fixed(rate, 1), "% — inspect equipment in zones with repeated spikes.")),
        _line(ratio > 1.8, priority="high", category="Load Management",
              text=_text("Shift peak load to off-peak hours. Peak is ", fixed(ratio, 1), "x above average.")),
        _line(score < 80, priority="high", category="Efficiency",
              text=_text("Efficiency score is ", fixed(score, 0), "/100. Upgrade equipment for 15–25% improvement.")),
        _line(c("voltage_deviation") > 3, priority="medium", category="Power Quality",
              text=_text("Voltage fluctuation ±", fixed(c("voltage_deviation"), 1), "V. Install automatic voltage regulators.")),
        _line(c("total_consumption") > 0, priority="info", category="Renewable Energy",
              text=_text("Total consumption of ", fixed(c("total_consumption"), 0),
                         " kWh suggests strong ROI for solar installation.")),
    ]
    return _fired(_dataset_figures(df), lines)


def average_tips(df: DataFrame, column: str = KWH, high: float = 120.0, low: float = 80.0) -> DataFrame:
    one = df.agg(F.avg(column).alias("avg"))
    # Limits (the defaults), priorities, categories and texts.
    return _fired(one, [
        _line(F.col("avg") > high, priority="high", category="Energy", text="Reduce peak load to improve efficiency."),
        _line(F.col("avg") < low, priority="info", category="Optimization", text="System operating efficiently."),
    ])


def fallback_forecast(df: DataFrame, column: str = KWH, last: int = 24, hours: int = 24) -> DataFrame:
    """Mean of the last rows plus their drift and a tenth of the mean as a half-day wave, with a 12 % band."""
    from wattline.operators.splits import latest

    tail = latest(df, last)
    order = F.struct(*[c for c in ("ts", "row_id") if c in df.columns])
    one = tail.agg(F.avg(column).alias("avg"), F.count(F.lit(1)).alias("n"),
                   F.max_by(column, order).alias("newest"), F.min_by(column, order).alias("oldest"))
    drift = F.when(F.col("n") > 1, (F.col("newest") - F.col("oldest")) / F.col("n")).otherwise(0.0)
    steps = one.withColumn("drift", drift).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    base = F.col("avg") + F.col("drift") * F.col("i") + F.sin(F.col("i") / 6 * math.pi) * F.col("avg") * 0.1
    return steps.select((F.col("i") + 1).alias("step"), F.round(base, 1).alias("forecast"),
                        F.round(base * 0.88, 1).alias("lower"), F.round(base * 1.12, 1).alias("upper"))
