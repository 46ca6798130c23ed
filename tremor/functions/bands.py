"""Label / band functions as native ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class ids, labels and markers of the classification output.
CLASS_LABELS = {0: "Faible", 1: "Modéré", 2: "Strong"}
CLASS_SYMBOLS = {0: "🟢", 1: "🟡", 2: "🔴"}

# Risk tiers, trend bands, direction and anomaly labels.
RISK_LOW, RISK_MID, RISK_HIGH = "faible", "modere", "eleve"
TREND_STRONG_UP, TREND_UP, TREND_STRONG_DOWN, TREND_DOWN, TREND_STABLE = (
    "forte_hausse", "hausse", "forte_baisse", "baisse", "stable")
DIRECTION_UP, DIRECTION_DOWN, DIRECTION_STABLE = "hausse", "baisse", "stable"
ANOMALY_HIGH, ANOMALY_MILD, ANOMALY_NORMAL = "anomalie", "inhabituel", "normal"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _map_lookup(col, mapping: dict) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _c(col))


def label_class(col) -> Column:
    """Class id -> label."""
    return _map_lookup(col, CLASS_LABELS)


def class_symbol(col) -> Column:
    """Class id -> marker symbol."""
    return _map_lookup(col, CLASS_SYMBOLS)


def risk_tier(col, p33, p66) -> Column:
    """P20: <= p33 low, <= p66 middle, else high (ties go to the lower tier)."""
    v = _c(col)
    return (F.when(v <= p33, F.lit(RISK_LOW))
            .when(v <= p66, F.lit(RISK_MID))
            .otherwise(F.lit(RISK_HIGH)))


def trend_band(diff) -> Column:
    """Week-on-week difference bands (>50, >10, <-50, <-10, else stable)."""
    d = _c(diff)
    return (F.when(d > 50, F.lit(TREND_STRONG_UP))
            .when(d > 10, F.lit(TREND_UP))
            .when(d < -50, F.lit(TREND_STRONG_DOWN))
            .when(d < -10, F.lit(TREND_DOWN))
            .otherwise(F.lit(TREND_STABLE)))


def direction(pred, current) -> Column:
    """Forecast direction, +-20 % band around the current value."""
    p, c = _c(pred), _c(current)
    return (F.when(p > c * F.lit(1.2), F.lit(DIRECTION_UP))
            .when(p < c * F.lit(0.8), F.lit(DIRECTION_DOWN))
            .otherwise(F.lit(DIRECTION_STABLE)))


def anomaly_band(z) -> Column:
    """|z| > 2 anomaly, > 1 unusual, else normal."""
    a = F.abs(_c(z))
    return (F.when(a > 2, F.lit(ANOMALY_HIGH))
            .when(a > 1, F.lit(ANOMALY_MILD))
            .otherwise(F.lit(ANOMALY_NORMAL)))
