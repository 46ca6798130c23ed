"""L3 — risk zones: assign events to zones, zone x week counts, upsert the
zone history, persistence prediction per zone, percentile risk tiers.

Event rows are touched once (scan -> per-row zone expression -> partial
aggregate).  Everything after the rollup is zones x weeks rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.bands import risk_tier
from tremor.functions.weeks import week_label
from tremor.operators.cleaning import only_kind
from tremor.operators.common import attach_row
from tremor.operators.geo import assign_zone_scaled, scaler_stats
from tremor.operators.stats import tier_bounds
from tremor.operators.windows import latest_per
from tremor.sources.documents import to_document
from tremor.session import materialize
from tremor.sources.history import upsert_period

# Ten zone centres (zone, lat, lon) used when no fitted model
# is supplied: latitudes -72..72 step 16, longitudes -162..162 step 36.
DEFAULT_CENTRES = [(i, -72.0 + 16.0 * i, -162.0 + 36.0 * i) for i in range(10)]


def zone_counts(zoned: DataFrame, ts: str = "time_utc", mode: str = "iso_start") -> DataFrame:
    """A5 + A6 + J2: zone x week counts with mean coordinates of that week."""
    return (zoned.groupBy(week_label(ts, mode).alias("date"), "zone")
            .agg(F.count(F.lit(1)).alias("nb_seismes"), F.avg("latitude").alias("latitude"),
                 F.avg("longitude").alias("longitude")))


def risk_zones(events: DataFrame, as_of: str, centres=DEFAULT_CENTRES, history: DataFrame | None = None,
               ts: str = "time_utc", stats: DataFrame | None = None, stale_as_zero: bool = False) -> DataFrame:
    """Zones job: returns (zone, pred_seismes, risk_level, lat, lon).

    ``stats`` are the scaler parameters (fitted offline; computed from the
    events when absent).  ``history`` is the stored zone history (date,
    zone, nb_seismes, latitude, longitude).  The current week is the 7-day
    look-back ending at ``as_of``, labelled by the Monday of ``as_of``'s
    week, and replaces any stored row for that week (S10).  A zone with no
    event this week keeps its older row as the prediction (reference
    behaviour); ``stale_as_zero=True`` predicts 0 for it instead (SURVEY D14).

    Without a stored history, history weeks and the current look-back come
    from ONE aggregate: each event carries the keys it counts under (its own
    week if before the current one, the current label if inside the
    look-back), so the events are scanned and shuffled once.
    """
    quakes = only_kind(events)
    if stats is None:
        stats = materialize(scaler_stats(quakes))
    zoned = assign_zone_scaled(quakes, centres, stats)
    week_start = F.to_date(F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz")))
    end = F.lit(as_of).cast("timestamp_ntz")
    in_lookback = F.col(ts).between(end - F.expr("INTERVAL 7 DAYS"), end)
    if history is None:
        keys = F.array_compact(F.array(
            F.when(F.to_date(F.col(ts)) < week_start, week_label(ts, "iso_start")),
            F.when(in_lookback, week_start)))
        hist = (zoned.select("zone", "latitude", "longitude", F.explode(keys).alias("date"))
                .groupBy("date", "zone").agg(F.count(F.lit(1)).alias("nb_seismes"),
                                             F.avg("latitude").alias("latitude"),
                                             F.avg("longitude").alias("longitude")))
    else:
        new = (zoned.where(in_lookback).groupBy("zone")
               .agg(F.count(F.lit(1)).alias("nb_seismes"), F.avg("latitude").alias("latitude"),
                    F.avg("longitude").alias("longitude"))
               .withColumn("date", week_start))
        hist = upsert_period(history, new, "date")
    latest = latest_per(hist.select("zone", "date", "nb_seismes", "latitude", "longitude"), "zone", "date")
    count = F.col("nb_seismes")
    if stale_as_zero:
        count = F.when(F.col("date") == week_start, count).otherwise(F.lit(0))
    pred = materialize(latest.withColumn("pred_seismes", count.cast("int")))  # one row per zone
    out = attach_row(pred, tier_bounds(pred, "pred_seismes"))
    return out.select("zone", "pred_seismes", risk_tier("pred_seismes", F.col("p33"), F.col("p66")).alias("risk_level"),
                      F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def zones_document(zones: DataFrame, as_of: str) -> DataFrame:
    """Zones document; the array holds one entry per zone (bounded by k)."""
    week_start = F.to_date(F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz")))
    header = {"generated_at": F.lit(as_of), "next_week_start": F.date_format(F.date_add(week_start, 7), "yyyy-MM-dd"),
              "nb_zones": F.count(F.lit(1)).cast("int")}
    return to_document(zones, header, "zones", ["zone", "pred_seismes", "risk_level", "lat", "lon"],
                       [("pred_seismes", True), ("zone", False)])
