"""Registered queries: scalar functions, filters, scans, sort/limit/union
(P1-P35 except P36; S2-S4, S9; O1, O2, O4, O5; A15, A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import scalars as S
from tremor.functions.weeks import iso_week, next_week_start, week_bounds
from tremor.operators import cleaning as C
from tremor.plans.catalog import register
from tremor.plans.report import finalize, r6, tstr
from tremor.plans.sqlparts import WITH_LONG, WITH_QUAKE
from tremor.sources.views import quake, quake_long

AS_OF = "2024-01-29 12:00:00"  # look-back anchor inside the events table's month


@register("P6_P7_P10_P13_event_prep", f"""{WITH_QUAKE}
    SELECT id, CAST(hour(time_utc) AS BIGINT) AS hour, CAST(isodow(time_utc) - 1 AS BIGINT) AS dayofweek,
           CAST(month(time_utc) AS BIGINT) AS month,
           {r6('ln(1 + coalesce(depth_km, 0))')} AS depth_km_log, {r6('ln(1 + coalesce(nst, 0))')} AS nst_log,
           {r6('ln(1 + coalesce(dmin, 0))')} AS dmin_log, {r6('ln(1 + coalesce(sig, 0))')} AS sig_log
    FROM quake WHERE type = 'earthquake'
      AND coalesce(depth_km BETWEEN 0 AND 700 AND mag BETWEEN 2 AND 9, false)""")
def q_event_prep(spark, sf_dir):
    """Serving prep: kind filter, physical range filter, time parts, log1p of counts."""
    df = C.range_filter(C.only_kind(quake(spark, sf_dir)))
    parts = S.time_parts("time_utc")
    return finalize(df.select(
        "id", parts["hour"].alias("hour"), parts["dayofweek"].alias("dayofweek"),
        parts["month"].alias("month"),
        *[S.log1p0(c).alias(f"{c}_log") for c in ("depth_km", "nst", "dmin", "sig")]))


@register("P2_P5_P32_time_convert", f"""{WITH_QUAKE}
    SELECT id, epoch_us(time_utc) // 1000 AS epoch_ms, {tstr('epoch_ms(epoch_us(time_utc) // 1000)')} AS time_back,
           strftime(CAST(time_utc AS DATE), '%Y-%m-%d') AS day FROM quake""")
def q_time_convert(spark, sf_dir):
    """Epoch-ms round trip (P2), timestamp -> date (P5), date text."""
    df = quake(spark, sf_dir).select("id", F.unix_millis(F.col("time_utc").cast("timestamp")).alias("epoch_ms"),
                                     "time_utc")
    return finalize(df.select("id", "epoch_ms", S.epoch_ms("epoch_ms").alias("time_back"),
                              S.fmt_date(S.to_day("time_utc")).alias("day")))


@register("P4_try_ts", f"""{WITH_QUAKE}
    SELECT id, {tstr("try_strptime(CASE WHEN tsunami = 1 THEN concat('bad-', place) ELSE strftime(time_utc, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S')")} AS parsed
    FROM quake""")
def q_try_ts(spark, sf_dir):
    """Coercing parse: malformed text becomes NULL instead of failing the job."""
    df = quake(spark, sf_dir)
    text = F.when(F.col("tsunami") == 1, F.concat(F.lit("bad-"), "place")).otherwise(
        F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss"))
    return finalize(df.select("id", S.try_ts(text, "yyyy-MM-dd HH:mm:ss").alias("parsed")))


@register("P11_P12_P14_P16_P18_P24_P25_P26_scalars", f"""{WITH_QUAKE}
    SELECT id, CAST(weekofyear(time_utc) AS BIGINT) AS week_of_year,
        {r6('sin(2 * pi() * weekofyear(time_utc) / 52.0)')} AS week_sin,
        {r6('cos(2 * pi() * weekofyear(time_utc) / 52.0)')} AS week_cos,
        {r6('ln(1 + pow(10.0, 1.5 * mag))')} AS log1p_energy,
        {r6('ln(1 + pow(10.0, 1.5 * coalesce(mag, 0.0)))')} AS log1p_energy_null0,
        CAST(trunc(greatest(mag - 4, 0)) AS BIGINT) AS mag_over_4,
        {r6('round(mag / 10 * 100.0, 1)')} AS mag_pct,
        {r6('coalesce(gap * 100.0 / nullif(nst, 0), 0.0)')} AS gap_per_nst_pct,
        CAST(sig AS VARCHAR) AS sig_text,
        {r6("CASE WHEN abs(CASE WHEN nst IS NULL THEN CAST('inf' AS DOUBLE) ELSE dmin END) = CAST('inf' AS DOUBLE) THEN NULL ELSE CASE WHEN nst IS NULL THEN CAST('inf' AS DOUBLE) ELSE dmin END END")} AS dmin_finite
    FROM quake""")
def q_scalars(spark, sf_dir):
    """ISO week (P11), cyclic encoding (P12), energy (P14), clamp+truncate (P16),
    percent rounding (P18), guarded percent (P24), casts (P25), inf -> NULL (P26)."""
    df = quake(spark, sf_dir)
    sin_w, cos_w = S.cyclic(iso_week("time_utc"), 52)
    raw = F.when(F.col("nst").isNull(), F.lit(float("inf"))).otherwise(F.col("dmin"))
    return finalize(df.select(
        "id", iso_week("time_utc").alias("week_of_year"), sin_w.alias("week_sin"), cos_w.alias("week_cos"),
        F.log1p(S.energy("mag")).alias("log1p_energy"),
        F.log1p(S.energy("mag", null_as_zero=True)).alias("log1p_energy_null0"),
        S.nonneg_int(F.col("mag") - 4).alias("mag_over_4"),
        S.pct(F.col("mag") / 10).alias("mag_pct"),
        S.safe_pct("gap", "nst").alias("gap_per_nst_pct"),
        F.col("sig").cast("string").alias("sig_text"),
        S.inf_to_null(raw).alias("dmin_finite")))


@register("P1_P3_conform", f"""{WITH_QUAKE}
    SELECT CAST(id AS VARCHAR) AS id, {tstr('time_utc')} AS time_utc, CAST(NULL AS VARCHAR) AS updated_utc,
        {r6('longitude')} AS longitude, {r6('latitude')} AS latitude, {r6('depth_km')} AS depth,
        place, {r6('mag')} AS mag, CAST(NULL AS VARCHAR) AS magType, CAST(nst AS BIGINT) AS nst,
        {r6('gap')} AS gap, {r6('dmin')} AS dmin, {r6('rms')} AS rms, net, CAST(NULL AS BIGINT) AS felt,
        CAST(NULL AS DOUBLE) AS cdi, CAST(NULL AS DOUBLE) AS mmi, CAST(NULL AS VARCHAR) AS alert,
        CAST(tsunami AS BIGINT) AS tsunami, CAST(sig AS BIGINT) AS sig, CAST(NULL AS VARCHAR) AS status,
        type AS event_type, CAST(NULL AS DOUBLE) AS horizontalError, CAST(NULL AS DOUBLE) AS depthError,
        CAST(NULL AS DOUBLE) AS magError, CAST(NULL AS BIGINT) AS magNst
    FROM quake""")
def q_conform(spark, sf_dir):
    """The 27-column event schema with typed NULLs; P3: rename and drop."""
    conformed = C.conform(quake(spark, sf_dir))
    return finalize(C.rename(conformed, {"depth_km": "depth", "type": "event_type"}, drop=["url"]))


@register("P8_drop_null", f"""{WITH_QUAKE}
    SELECT id, {r6('gap')} AS gap, {r6('rms')} AS rms, CAST(nst AS BIGINT) AS nst
    FROM quake WHERE gap IS NOT NULL AND rms IS NOT NULL AND nst IS NOT NULL""")
def q_drop_null(spark, sf_dir):
    return finalize(C.drop_null(quake(spark, sf_dir).select("id", "gap", "rms", "nst"), ["gap", "rms", "nst"]))


@register("P9_exclude", f"""{WITH_QUAKE}
    SELECT id, type FROM quake WHERE NOT coalesce(type = 'quarry blast' AND mag > 4, false)""")
def q_exclude(spark, sf_dir):
    """Drop a named bad subset; rows whose predicate is NULL are kept."""
    df = quake(spark, sf_dir)
    return finalize(C.exclude(df, (F.col("type") == "quarry blast") & (F.col("mag") > 4)).select("id", "type"))


@register("P34_fill0", f"""{WITH_QUAKE}
    SELECT id, {r6('coalesce(gap, 0)')} AS gap, {r6('coalesce(rms, 0)')} AS rms,
           CAST(coalesce(nst, 0) AS BIGINT) AS nst FROM quake""")
def q_fill0(spark, sf_dir):
    return finalize(C.fill0(quake(spark, sf_dir).select("id", "gap", "rms", "nst"), ["gap", "rms", "nst"]))


@register("P30_week_bounds", f"""{WITH_QUAKE}
    SELECT id, {tstr("date_trunc('week', time_utc)")} AS week_start,
           {tstr("date_trunc('week', time_utc) + INTERVAL '6 days 23 hours 59 minutes 59 seconds'")} AS week_end,
           strftime(CAST(date_trunc('week', time_utc) AS DATE) + 7, '%Y-%m-%d') AS next_week_start
    FROM quake""")
def q_week_bounds(spark, sf_dir):
    df = quake(spark, sf_dir)
    start, end = week_bounds("time_utc")
    return finalize(df.select("id", start.alias("week_start"), end.alias("week_end"),
                              next_week_start("time_utc").alias("next_week_start")))


@register("P31_lookback_24h", f"""{WITH_QUAKE}
    SELECT id, {tstr('time_utc')} AS time_utc FROM quake
    WHERE time_utc BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}'""")
def q_lookback_24h(spark, sf_dir):
    """Look-back window [as_of - 24 h, as_of] of the classification job."""
    return finalize(C.lookback(quake(spark, sf_dir), AS_OF, "24 HOURS").select("id", "time_utc"))


@register("P31_lookback_7d", f"""{WITH_QUAKE}
    SELECT id, {tstr('time_utc')} AS time_utc FROM quake
    WHERE time_utc BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}'""")
def q_lookback_7d(spark, sf_dir):
    """Look-back window [as_of - 7 d, as_of] of the zones job."""
    return finalize(C.lookback(quake(spark, sf_dir), AS_OF, "7 DAYS").select("id", "time_utc"))


@register("S2_scan_events", f"""{WITH_LONG}
    SELECT id, {tstr('time_utc')} AS time_utc, {r6('mag')} AS mag FROM quake_long
    WHERE time_utc >= TIMESTAMP '1996-01-01' AND time_utc < TIMESTAMP '1997-01-01' AND mag >= 7.0""")
def q_scan_events(spark, sf_dir):
    """Time-range + minimum-magnitude scan (filters pushed to Parquet)."""
    df = C.scan_events(quake_long(spark, sf_dir), "1996-01-01", "1997-01-01", min_mag=7.0)
    return finalize(df.select("id", "time_utc", "mag"))


@register("S3_date_chunks", f"""{WITH_LONG},
    b AS (SELECT CAST(min(time_utc) AS DATE) AS lo, CAST(max(time_utc) AS DATE) + 1 AS hi FROM quake_long),
    s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 YEAR)) AS DATE) AS chunk_start, hi FROM b)
    SELECT strftime(chunk_start, '%Y-%m-%d') AS chunk_start,
           strftime(least(coalesce(lead(chunk_start) OVER (ORDER BY chunk_start), hi), hi), '%Y-%m-%d') AS chunk_end
    FROM s WHERE chunk_start < hi""")
def q_date_chunks(spark, sf_dir):
    """Yearly half-open chunks over the catalogue's own time range."""
    return finalize(C.date_chunks(quake_long(spark, sf_dir), years=1))


@register("S4_union_chunks", f"""{WITH_LONG},
    b AS (SELECT CAST(min(time_utc) AS DATE) AS lo, CAST(max(time_utc) AS DATE) + 1 AS hi FROM quake_long),
    s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 YEAR)) AS DATE) AS chunk_start FROM b)
    SELECT id, strftime((SELECT max(chunk_start) FROM s WHERE chunk_start <= time_utc), '%Y-%m-%d') AS chunk_start
    FROM quake_long WHERE time_utc IS NOT NULL""")
def q_union_chunks(spark, sf_dir):
    """All yearly chunks of the data's own range (S3) in one scan, the chunk
    as a column."""
    return finalize(C.with_chunk(quake_long(spark, sf_dir).select("id", "time_utc")).select("id", "chunk_start"))


@register("S9_empty_default", f"""{WITH_QUAKE}
    SELECT count(*) AS total, {r6('coalesce(max(mag), 0.0)')} AS mag_max,
           {r6('coalesce(avg(depth_km), 0.0)')} AS depth_mean,
           CAST(coalesce(sum(tsunami), 0) AS BIGINT) AS tsunami_sum
    FROM quake WHERE time_utc >= TIMESTAMP '2030-01-01'""")
def q_empty_default(spark, sf_dir):
    """Empty batch contract: one row of zeros, never no row."""
    df = quake(spark, sf_dir).where(F.col("time_utc") >= F.lit("2030-01-01").cast("timestamp_ntz"))
    out = C.with_empty_default(
        df, {"total": F.count(F.lit(1)), "mag_max": F.max("mag"), "depth_mean": F.avg("depth_km"),
             "tsunami_sum": F.sum(F.col("tsunami").cast("bigint"))},
        {"mag_max": 0.0, "depth_mean": 0.0, "tsunami_sum": 0})
    return finalize(out.withColumn("tsunami_sum", F.col("tsunami_sum").cast("bigint")))


@register("O1_sort_events", f"""{WITH_QUAKE}
    SELECT id, {tstr('time_utc')} AS time_utc, {r6('mag')} AS mag FROM quake ORDER BY time_utc DESC, id""")
def q_sort(spark, sf_dir):
    return finalize(quake(spark, sf_dir).select("id", "time_utc", "mag")
                    .orderBy(F.desc("time_utc"), F.asc("id")))


@register("O2_top_magnitudes", f"""{WITH_QUAKE}
    SELECT id, {r6('mag')} AS mag FROM quake ORDER BY mag DESC NULLS LAST, id LIMIT 20""")
def q_top(spark, sf_dir):
    """Top-20 report by magnitude (the limit is the feature)."""
    return finalize(quake(spark, sf_dir).select("id", "mag")
                    .orderBy(F.desc_nulls_last("mag"), F.asc("id")).limit(20))


@register("O4_sample_n", f"""{WITH_QUAKE}
    SELECT id, {r6('latitude')} AS latitude, {r6('longitude')} AS longitude FROM quake
    ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 1000""")
def q_sample(spark, sf_dir):
    """Seeded sample of exactly 1,000 rows without replacement, seed 42 (the
    sample size is the feature)."""
    return finalize(C.sample_n(quake(spark, sf_dir).select("id", "latitude", "longitude"), 1000, seed=42))


@register("O5_union", f"""{WITH_QUAKE} SELECT id, type FROM quake""")
def q_union(spark, sf_dir):
    df = quake(spark, sf_dir).select("id", "type")
    return finalize(C.union_chunks([df.where(F.col("type") == "earthquake"),
                                    df.where(F.col("type") != "earthquake")]))


@register("A15_dedup_first", f"""{WITH_QUAKE}
    SELECT place, {tstr('time_utc')} AS time_utc, id, {r6('mag')} AS mag FROM (
      SELECT place, time_utc, id, mag,
             row_number() OVER (PARTITION BY place ORDER BY time_utc NULLS LAST, id, mag NULLS FIRST) AS rn FROM quake) WHERE rn = 1""")
def q_dedup(spark, sf_dir):
    """Earliest event per place (keep-first dedup on a key)."""
    df = quake(spark, sf_dir).select("place", "time_utc", "id", "mag")
    return finalize(C.dedup_first(df, "place", "time_utc"))


@register("A15_dedup_by_id", f"""{WITH_QUAKE},
    d AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE time_utc END AS time_utc, mag FROM quake
          UNION ALL SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE time_utc - INTERVAL 1 HOUR END, mag FROM quake WHERE id % 3 = 0)
    SELECT id, {tstr('time_utc')} AS time_utc, {r6('mag')} AS mag FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_utc NULLS LAST, mag NULLS FIRST) AS rn FROM d) WHERE rn = 1""")
def q_dedup_id(spark, sf_dir):
    """Keep-first dedup by id over re-delivered events, some without a time;
    an id without any time is kept."""
    df = quake(spark, sf_dir).select("id", "time_utc", "mag")
    first = df.withColumn("time_utc", F.when(F.col("id") % 5 != 0, F.col("time_utc")))
    again = df.where("id % 3 = 0").withColumn("time_utc", F.when(F.col("id") % 10 != 0, F.col("time_utc") - F.expr("INTERVAL 1 HOUR")))
    return finalize(C.dedup_first(first.unionByName(again), "id", "time_utc"))


@register("A16_dup_count", f"""{WITH_QUAKE}
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates
    FROM (SELECT count(*) AS n FROM quake GROUP BY net, place, tsunami)""")
def q_dup_count(spark, sf_dir):
    return finalize(C.dup_count(quake(spark, sf_dir).select("net", "place", "tsunami")))
