"""Registered queries: zones (M1, M2, J7, L3 risk zones, S7 document)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators.cleaning import only_kind
from tremor.operators.geo import assign_zone_scaled, fit_zones, scaler_stats, standardise
from tremor.operators.common import attach_row
from tremor.operators.rollup import value_counts
from tremor.plans.catalog import register
from tremor.plans.report import finalize, r6
from tremor.plans.sqlparts import WITH_QUAKE
from tremor.plans.zones import DEFAULT_CENTRES, risk_zones, zones_document
from tremor.session import materialize
from tremor.sources.views import quake

AS_OF = "2024-01-29 12:00:00"
WEEK_START = "2024-01-29"

_CENTRES_SQL = ", ".join(f"({z}, {a!r}, {b!r})" for z, a, b in DEFAULT_CENTRES)
ZONED_SQL = f"""{WITH_QUAKE},
    eq AS (SELECT * FROM quake WHERE type = 'earthquake' AND latitude IS NOT NULL AND longitude IS NOT NULL),
    st AS (SELECT stddev_pop(latitude) AS sx, stddev_pop(longitude) AS sy FROM eq),
    c(zone, cx, cy) AS (VALUES {_CENTRES_SQL}),
    dist AS (SELECT eq.id, eq.time_utc, eq.latitude, eq.longitude, c.zone,
                    ((eq.latitude - c.cx) / sx) * ((eq.latitude - c.cx) / sx)
                    + ((eq.longitude - c.cy) / sy) * ((eq.longitude - c.cy) / sy) AS d
             FROM eq, st, c),
    zoned AS (SELECT id, time_utc, latitude, longitude, zone FROM (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, zone) AS rn FROM dist) WHERE rn = 1)"""


@register("M1_scaler_stats", f"""{WITH_QUAKE}
    SELECT {r6('avg(latitude)')} AS latitude_mean, {r6('stddev_pop(latitude)')} AS latitude_sd,
           {r6('avg(longitude)')} AS longitude_mean, {r6('stddev_pop(longitude)')} AS longitude_sd
    FROM quake WHERE type = 'earthquake' AND latitude IS NOT NULL AND longitude IS NOT NULL""")
def q_scaler(spark, sf_dir):
    """Standardisation parameters of (lat, lon) (population sd)."""
    return finalize(scaler_stats(only_kind(quake(spark, sf_dir))))


@register("M1_standardise", f"""{WITH_QUAKE},
    eq AS (SELECT * FROM quake WHERE type = 'earthquake' AND latitude IS NOT NULL AND longitude IS NOT NULL),
    st AS (SELECT avg(latitude) AS mx, stddev_pop(latitude) AS sx, avg(longitude) AS my, stddev_pop(longitude) AS sy FROM eq)
    SELECT id, {r6('(latitude - mx) / sx')} AS latitude_z, {r6('(longitude - my) / sy')} AS longitude_z FROM eq, st""")
def q_standardise(spark, sf_dir):
    """Standardised coordinates of every event (population sd)."""
    eq = only_kind(quake(spark, sf_dir)).where("latitude is not null and longitude is not null")
    return finalize(standardise(eq.select("id", "latitude", "longitude"), scaler_stats(eq)).select("id", "latitude_z", "longitude_z"))


@register("J7_assign_zone", f"""{ZONED_SQL} SELECT id, CAST(zone AS BIGINT) AS zone FROM zoned""")
def q_assign(spark, sf_dir):
    """Nearest of ten centres on standardised coordinates, per event."""
    quakes = only_kind(quake(spark, sf_dir))
    return finalize(assign_zone_scaled(quakes, DEFAULT_CENTRES, scaler_stats(quakes)).select("id", "zone"))


@register("L3_risk_zones", f"""{ZONED_SQL},
    hist AS (SELECT CAST(date_trunc('week', time_utc) AS DATE) AS date, zone, count(*) AS nb,
                    avg(latitude) AS lat, avg(longitude) AS lon
             FROM zoned WHERE CAST(time_utc AS DATE) < DATE '{WEEK_START}' GROUP BY 1, 2),
    new AS (SELECT DATE '{WEEK_START}' AS date, zone, count(*) AS nb, avg(latitude) AS lat, avg(longitude) AS lon
            FROM zoned WHERE time_utc BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}'
            GROUP BY zone),
    h2 AS (SELECT * FROM hist WHERE date NOT IN (SELECT date FROM new) UNION ALL SELECT * FROM new),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY date DESC) AS rn FROM h2) WHERE rn = 1),
    t AS (SELECT quantile_cont(nb, 0.33) AS p33, quantile_cont(nb, 0.66) AS p66 FROM latest)
    SELECT CAST(zone AS BIGINT) AS zone, CAST(nb AS BIGINT) AS pred_seismes,
           CASE WHEN nb <= p33 THEN 'faible' WHEN nb <= p66 THEN 'modere' ELSE 'eleve' END AS risk_level,
           {r6('lat')} AS lat, {r6('lon')} AS lon
    FROM latest, t""")
def q_risk(spark, sf_dir):
    """Risk zones: zone assignment, history upsert, persistence prediction, tiers."""
    return finalize(risk_zones(quake(spark, sf_dir), AS_OF))


@register("S7_zones_document")
def q_zones_doc(spark, sf_dir):
    """Zones document (header + zones ordered by predicted count) as JSON text."""
    doc = zones_document(risk_zones(quake(spark, sf_dir), AS_OF), AS_OF)
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("document"))


@register("M2_kmeans_zones")
def q_kmeans(spark, sf_dir):
    """k-means (k=10, seed 42) on standardised coordinates; zone sizes."""
    quakes = only_kind(quake(spark, sf_dir)).select("id", "latitude", "longitude")
    from tremor.operators.geo import assign_zone_model
    scaler, km = fit_zones(quakes, k=10, seed=42)
    return finalize(value_counts(assign_zone_model(quakes, scaler, km), "zone"))


@register("M2_kmeans_invariants", f"""{WITH_QUAKE},
    eq AS (SELECT * FROM quake WHERE type = 'earthquake' AND latitude IS NOT NULL AND longitude IS NOT NULL)
    SELECT count(*) AS points, count(*) AS at_nearest_centre, 10 AS zones, 1 AS cost_fits, 1 AS centres_are_means, 1 AS below_one_centre FROM eq""")
def q_kmeans_invariants(spark, sf_dir):
    """What holds of any k-means fit, from the fitted centres: every point is in
    the zone of its nearest centre, the reported cost is the sum of these
    distances, centres are the means of their points (within the rounds'
    tolerance), and the cost is below that of one centre."""
    from tremor.operators.geo import assign_zone_model
    quakes = only_kind(quake(spark, sf_dir)).select("id", "latitude", "longitude")
    scaler, km = fit_zones(quakes, k=10, seed=42, max_iter=200)
    mean, sd = [float(x) for x in scaler.mean], [float(x) for x in scaler.std]
    rows = assign_zone_model(quakes, scaler, km).withColumns(
        {"x": (F.col("latitude") - mean[0]) / sd[0], "y": (F.col("longitude") - mean[1]) / sd[1]})
    gap = [(F.col("x") - float(a)) ** 2 + (F.col("y") - float(b)) ** 2 for a, b in km.clusterCenters()]
    rows = materialize(rows.withColumn("gaps", F.array(*gap)).withColumn("own", F.element_at("gaps", F.col("zone") + 1)))
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in km.clusterCenters()])
    centre = F.element_at(centres, F.col("zone") + 1)
    means = rows.groupBy("zone").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).agg(
        F.max(F.greatest(F.abs(F.col("mx") - centre[0]), F.abs(F.col("my") - centre[1]))).alias("off"))
    told = rows.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("own") <= F.array_min("gaps") + 1e-9).alias("at_nearest_centre"),
                    F.countDistinct("zone").alias("zones"), F.sum("own").alias("cost"), F.sum(F.col("x") ** 2 + F.col("y") ** 2).alias("one"))
    cost = float(km.summary.trainingCost)
    out = attach_row(told, means).withColumns({"cost_fits": F.abs(F.col("cost") - cost) <= 1e-6 * F.lit(cost) + 1e-9,
                                              "centres_are_means": F.col("off") < 0.01, "below_one_centre": F.col("cost") < F.col("one")})
    return finalize(out.select("points", "at_nearest_centre", "zones", "cost_fits", "centres_are_means", "below_one_centre"))
