"""Projection, filters, null handling and dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.session import materialize

# The 27-column event schema and its order (FIXTURES.md §1.2).
EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("time_utc", T.TimestampType()),
    T.StructField("updated_utc", T.TimestampType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("depth_km", T.DoubleType()),
    T.StructField("place", T.StringType()), T.StructField("mag", T.DoubleType()),
    T.StructField("magType", T.StringType()), T.StructField("nst", T.IntegerType()),
    T.StructField("gap", T.DoubleType()), T.StructField("dmin", T.DoubleType()),
    T.StructField("rms", T.DoubleType()), T.StructField("net", T.StringType()),
    T.StructField("felt", T.IntegerType()), T.StructField("cdi", T.DoubleType()),
    T.StructField("mmi", T.DoubleType()), T.StructField("alert", T.StringType()),
    T.StructField("tsunami", T.IntegerType()), T.StructField("sig", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("horizontalError", T.DoubleType()), T.StructField("depthError", T.DoubleType()),
    T.StructField("magError", T.DoubleType()), T.StructField("magNst", T.IntegerType()),
    T.StructField("url", T.StringType()),
])

# Physical bounds of the serving range filter.
PHYSICAL_BOUNDS = {"depth_km": (0.0, 700.0), "mag": (2.0, 9.0)}


def conform(df: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Project to a fixed column list/order; absent columns become typed NULLs."""
    present = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in schema.fields])


def rename(df: DataFrame, mapping: dict[str, str], drop=()) -> DataFrame:
    """Drop and rename columns."""
    return df.drop(*drop).withColumnsRenamed(mapping)


def only_kind(df: DataFrame, kind: str = "earthquake", col: str = "type") -> DataFrame:
    """Equality filter on the event kind (pushed to the scan).

    A catalogue without a kind column holds a single kind and passes as is.
    """
    if col not in df.columns:
        return df
    return df.where(F.col(col) == F.lit(kind))


def range_filter(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    """Every column within [lo, hi]; NULL fails the test (as NaN does)."""
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        cond = cond & F.col(c).between(lo, hi)
    return df.where(F.coalesce(cond, F.lit(False)))


def drop_null(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns when None)."""
    return df.dropna(how="any", subset=subset)


def exclude(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows matching ``predicate``; a NULL predicate keeps the row."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def fill0(df: DataFrame, cols) -> DataFrame:
    """Constant NULL fill with 0."""
    return df.fillna(0, subset=list(cols))


def lookback(df: DataFrame, as_of: str, interval: str, ts: str = "time_utc") -> DataFrame:
    """Rows with ``as_of - interval <= ts <= as_of`` (as_of is a parameter)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where(F.col(ts).between(end - F.expr(f"INTERVAL {interval}"), end))


def scan_events(df: DataFrame, start: str, end: str, min_mag: float | None = None,
                order: str = "desc", limit: int | None = None, ts: str = "time_utc") -> DataFrame:
    """Half-open time range [start, end) and minimum magnitude.

    Both predicates are simple comparisons, so they reach the Parquet scan
    as pushed filters.  ``limit`` (the source's page cap) is optional; the
    default reads every matching row.
    """
    cond = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    if min_mag is not None:
        cond = cond & (F.col("mag") >= F.lit(float(min_mag)))
    out = df.where(cond)
    if order:
        key = F.desc(ts) if order == "desc" else F.asc(ts)
        out = out.orderBy(key, F.asc("id"))
    return out.limit(limit) if limit else out


def date_chunks_list(start: str, end: str, years: int = 1) -> list[tuple[str, str]]:
    """S3 (driver side, parameters only): half-open n-year chunks, last one clipped.

    Adding an interval clips 29 February to 28 February (SURVEY D15).
    """
    import datetime as dt

    def add_years(d: dt.date, n: int) -> dt.date:
        try:
            return d.replace(year=d.year + n)
        except ValueError:
            return d.replace(year=d.year + n, day=28)

    cur, stop = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    out = []
    while cur < stop:
        nxt = min(add_years(cur, years), stop)
        out.append((cur.isoformat(), nxt.isoformat()))
        cur = nxt
    return out


def date_chunks(df: DataFrame, years: int = 1, ts: str = "time_utc") -> DataFrame:
    """S3: yearly chunk table over the data's own time range (one row per chunk)."""
    bounds = df.agg(F.to_date(F.min(ts)).alias("lo"), F.date_add(F.to_date(F.max(ts)), 1).alias("hi"))
    starts = bounds.select("hi", F.explode(
        F.sequence("lo", "hi", F.expr(f"INTERVAL {years} YEAR"))).alias("chunk_start"))
    from pyspark.sql import Window
    w = Window.orderBy("chunk_start")
    return (starts.where(F.col("chunk_start") < F.col("hi"))
            .withColumn("chunk_end", F.least(F.coalesce(F.lead("chunk_start").over(w), F.col("hi")), F.col("hi")))
            .select("chunk_start", "chunk_end"))


def with_chunk(df: DataFrame, years: int = 1, ts: str = "time_utc") -> DataFrame:
    """S3 + S4 in one scan: each row with the start of its n-year chunk of the
    data's own range (:func:`date_chunks`), instead of one scan per chunk and
    a union.  Rows without a time are in no chunk."""
    from tremor.operators.common import attach_row
    out = attach_row(df.where(F.col(ts).isNotNull()), df.agg(F.to_date(F.min(ts)).alias("__lo")))
    months = F.months_between(F.to_date(ts), F.col("__lo"))
    back = F.add_months("__lo", (F.floor(months / (12 * years)) * (12 * years)).cast("int"))
    return out.withColumn("chunk_start", back).drop("__lo")


def union_chunks(dfs) -> DataFrame:
    """Union of chunk scans by column name (missing columns become NULL)."""
    dfs = list(dfs)
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def dedup_first(df: DataFrame, key: str, ts: str = "time_utc") -> DataFrame:
    """Keep the earliest row per key; ties broken by the other columns.
    Rows without a time come after all others of their key, so a key whose
    rows have none keeps one of them.

    ``min_by`` over a struct is an ordinary aggregate with a map-side
    partial step, so a key holding a third of all rows is pre-reduced in
    every task instead of being sorted in one.
    """
    others = [c for c in df.columns if c not in (key, ts)]
    order_key = F.struct(F.col(ts).isNull().alias("__late"), F.col(ts), *[F.col(c) for c in others])
    packed = F.min_by(F.struct(*[F.col(c) for c in df.columns if c != key]), order_key)
    return df.groupBy(key).agg(packed.alias("__r")).select(key, "__r.*")


def dup_count(df: DataFrame) -> DataFrame:
    """Number of exact duplicate rows (rows beyond the first copy)."""
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return grouped.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def with_empty_default(df: DataFrame, aggs: dict[str, Column], defaults: dict[str, object]) -> DataFrame:
    """A global aggregate (always exactly one row) with zero defaults."""
    row = df.agg(*[a.alias(n) for n, a in aggs.items()])
    return row.select([F.coalesce(F.col(n), F.lit(defaults[n])).alias(n) if n in defaults else F.col(n)
                       for n in aggs])


def seeded_hash(key: str, seed: int) -> Column:
    """md5 of ``key:seed``: a hash that any SQL engine computes alike."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id", slack: float = 0.05) -> DataFrame:
    """Deterministic sample of exactly ``min(n, rows)`` rows without
    replacement: the ``n`` rows with the smallest seeded hash of the key.

    A plain ``orderBy().limit(n)`` would gather ``n`` rows from every input
    partition into one task.  Instead the hash (md5 text, uniform over its
    range) is first cut at the quantile n/rows plus a margin — a filter,
    computed in every task — and only the ~n candidates are sorted.  The
    result is exact: every row outside the cut hashes above every
    candidate; if the cut ever keeps fewer than n rows, it is widened.
    """
    h = seeded_hash(key, seed)
    total = df.count()
    if total <= n:
        return df
    # position of the hash in [0, 1), from its first 48 bits
    pos = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(2.0 ** 48)
    frac = min(1.0, n / total * (1 + slack) + 10.0 / total)
    while True:
        cand = materialize(df.where(pos < F.lit(frac)))
        if frac >= 1.0 or cand.count() >= n:
            return cand.orderBy(h, F.col(key)).limit(n)
        frac = min(1.0, frac * 1.5)
