"""Alert rules as column builders, and the alert rows they produce."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.labels import NOMINAL_VOLTAGE
from wattline.sources.readings import ROW, SERIES, TS
from wattline.sources.results import DEFAULT_SETTINGS


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, halves away from zero."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))


@dataclass(frozen=True)
class Rule:
    """``condition`` and ``message`` map the settings to columns; ``needs`` names the inputs."""

    name: str
    severity: str
    needs: tuple[str, ...]
    condition: Callable[[Mapping], Column]
    message: Callable[[Mapping], Column]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _number(value: float) -> str:
    return f"{value:g}"


# Rule names, severities and message texts of the alert table.
RULES = (
    Rule("high_consumption", "warning", ("consumption_kwh",),
         lambda s: F.col("consumption_kwh") > s["alert_consumption_threshold"],
         lambda s: _text("High energy consumption detected: ", fixed(F.col("consumption_kwh"), 1),
                         f" kWh (threshold: {_number(s['alert_consumption_threshold'])} kWh)")),
    Rule("anomaly_detected", "critical", ("anomaly_flag", "anomaly_severity", "anomaly_score"),
         lambda s: F.col("anomaly_flag") == 1,
         lambda s: _text("Anomaly detected — severity: ", F.col("anomaly_severity"), ", score: ",
                         fixed(F.col("anomaly_score"), 3))),
    Rule("equipment_critical", "critical", ("health_status", "maintenance_urgency"),
         lambda s: F.col("health_status") == "critical",
         lambda s: _text("Equipment in CRITICAL state — maintenance urgency: ",
                         fixed(F.col("maintenance_urgency"), 0), "%")),
    Rule("equipment_warning", "warning", ("health_status",),
         lambda s: F.col("health_status") == "warning",
         lambda s: _text("Equipment WARNING — recommend inspection within 48 hours")),
    Rule("voltage_deviation", "warning", ("voltage",),
         lambda s: F.abs(F.col("voltage") - NOMINAL_VOLTAGE) > s["alert_voltage_deviation"],
         lambda s: _text("Voltage deviation detected: ", fixed(F.col("voltage"), 1), "V (nominal: 230V)")),
    Rule("peak_hour_high_load", "info", ("is_peak_hour", "load_factor"),
         lambda s: (F.col("is_peak_hour") == 1) & (F.col("load_factor") > s["alert_load_factor_threshold"]),
         lambda s: _text("High load factor during peak hours: ", fixed(F.col("load_factor"), 2),
                         ". Consider load shifting.")),
    Rule("inefficient_consumption", "info", ("efficiency_label", "efficiency_score"),
         lambda s: F.col("efficiency_label") == "inefficient",
         lambda s: _text("System operating in inefficient cluster. Efficiency score: ",
                         fixed(F.col("efficiency_score"), 1), "/100")),
)


def alerts(df: DataFrame, settings: Mapping | None = None, rules: Sequence[Rule] = RULES,
           carry: Sequence[str] = (SERIES, TS, ROW), with_data: bool = True) -> DataFrame:
    """One row per reading and fired rule: keys, rule, severity, message and the reading as a map.

    Rules whose inputs are absent never fire; a null input never fires.
    """
    limits = {**DEFAULT_SETTINGS, **(settings or {})}
    usable = [r for r in rules if set(r.needs) <= set(df.columns)]
    keys = [c for c in carry if c in df.columns]
    cells = [
        F.when(r.condition(limits), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.message(limits).alias("message")))
        for r in usable
    ]
    if not cells:
        raise ValueError("no rule has its inputs in this table")
    fired = df.withColumn("_fired", F.filter(F.array(*cells), lambda c: c.isNotNull())).filter(F.size("_fired") > 0)
    out = [*keys, F.explode("_fired").alias("_alert")]
    if with_data:
        pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]
        out.insert(-1, F.create_map(*pairs).alias("data"))
    picked = fired.select(*out)
    return picked.select(*keys, "_alert.rule", "_alert.severity", "_alert.message", *(["data"] if with_data else []))


def first_per_rule(fired: DataFrame, order: Sequence[str] = (TS, ROW)) -> DataFrame:
    """The earliest alert of each rule, which is all a batch shorter than the cooldown can emit."""
    order = [c for c in order if c in fired.columns]
    rest = [c for c in fired.columns if c != "rule"]
    first = fired.groupBy("rule").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_a"))
    return first.select("rule", "_a.*").select(*fired.columns)


def spikes(df: DataFrame, column: str = "consumption_kwh", warn: float = 120.0, critical: float = 140.0) -> DataFrame:
    return df.filter(F.col(column) > warn).select(
        *[c for c in (SERIES, TS, ROW) if c in df.columns], F.lit("High Consumption").alias("rule"),
        F.when(F.col(column) > critical, "critical").otherwise("warning").alias("severity"),
        _text("Energy spike detected: ", F.col(column).cast("string"), " kWh").alias("message"))
