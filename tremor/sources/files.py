"""File sources and sinks: GeoJSON (S1), CSV (S5, S6), JSON documents (S8),
MLlib model artefacts (S11).

Every reader takes an explicit schema (no inference in production).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.functions.scalars import epoch_ms

# GeoJSON feature properties of the event feed (FIXTURES.md §1.1).
GEOJSON_PROPERTIES = T.StructType([
    T.StructField("mag", T.DoubleType()), T.StructField("place", T.StringType()),
    T.StructField("time", T.LongType()), T.StructField("updated", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("felt", T.IntegerType()),
    T.StructField("cdi", T.DoubleType()), T.StructField("mmi", T.DoubleType()),
    T.StructField("alert", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("tsunami", T.IntegerType()), T.StructField("sig", T.IntegerType()),
    T.StructField("net", T.StringType()), T.StructField("nst", T.IntegerType()),
    T.StructField("dmin", T.DoubleType()), T.StructField("rms", T.DoubleType()),
    T.StructField("gap", T.DoubleType()), T.StructField("magType", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("magError", T.DoubleType()),
    T.StructField("magNst", T.IntegerType()), T.StructField("horizontalError", T.DoubleType()),
    T.StructField("depthError", T.DoubleType()),
])
GEOJSON_FEATURE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("properties", GEOJSON_PROPERTIES),
    T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
])
GEOJSON_SCHEMA = T.StructType([T.StructField("features", T.ArrayType(GEOJSON_FEATURE))])


def flatten_features(docs: DataFrame) -> DataFrame:
    """One row per feature; properties flattened, [lon, lat, depth] split.

    ``get`` returns NULL for a short coordinate array instead of failing.
    """
    f = docs.select(F.explode("features").alias("f"))
    coords = F.col("f.geometry.coordinates")
    props = [F.col(f"f.properties.{p.name}").alias(p.name) for p in GEOJSON_PROPERTIES.fields
             if p.name not in ("time", "updated")]
    return f.select(
        F.col("f.id").alias("id"),
        epoch_ms(F.col("f.properties.time")).alias("time_utc"),
        epoch_ms(F.col("f.properties.updated")).alias("updated_utc"),
        F.get(coords, 0).alias("longitude"), F.get(coords, 1).alias("latitude"),
        F.get(coords, 2).alias("depth_km"), *props)


def read_geojson(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """GeoJSON FeatureCollection documents -> events.

    ``multiline=True`` reads one (pretty-printed) document per file, as a
    feed download is stored; ``False`` reads one document per line.
    """
    docs = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", multiline).json(path)
    return flatten_features(docs)


def to_geojson_lines(events: DataFrame, batch: int = 1000) -> DataFrame:
    """Events -> FeatureCollection documents of at most ``batch`` features,
    one JSON document per row.  Rows are grouped by their position inside
    their own input partition, so every group is bounded by ``batch``."""
    feature = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct(F.col("mag"), F.col("place"), F.unix_millis(F.col("time_utc").cast("timestamp")).alias("time"),
                 F.col("tsunami"), F.col("sig"), F.col("net"), F.col("nst"), F.col("dmin"), F.col("rms"),
                 F.col("gap"), F.col("type")).alias("properties"),
        F.struct(F.array("longitude", "latitude", "depth_km").alias("coordinates")).alias("geometry"))
    chunk = F.floor(F.monotonically_increasing_id() / F.lit(batch))
    docs = events.groupBy(chunk.alias("__chunk")).agg(F.collect_list(feature).alias("features"))
    return docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema (dates parsed by type)."""
    return (spark.read.schema(schema).option("header", True)
            .option("timestampFormat", "yyyy-MM-dd[ HH:mm:ss][XXX]").csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite sink (one folder of part files, written in parallel)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=None) -> None:
    """Internal tables are Parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested JSON documents with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system (HDFS, object store, local)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_model(model, path: str) -> str:
    """MLlib model/pipeline artefact (overwrite); returns its path."""
    model.write().overwrite().save(path)
    return path


def load_model(cls, path: str):
    """Load an artefact written by :func:`save_model`."""
    return cls.load(path)


def write_event_table(df: DataFrame, path: str, ts: str = "time_utc") -> None:
    """Event table partitioned by month of the event time, so time-range
    scans prune whole partitions before any file is opened.  Rows are dealt by
    ranges of (month, time), so a large month is written by many tasks and its
    files hold disjoint times."""
    (df.withColumn("event_month", F.date_format(F.col(ts), "yyyy-MM"))
     .repartitionByRange("event_month", ts)
     .write.mode("overwrite").partitionBy("event_month").parquet(path))


def read_event_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                     ts: str = "time_utc") -> DataFrame:
    """Scan of a month-partitioned event table for [start, end): a partition
    filter on the month (pruning) plus the exact pushed time predicate."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("event_month") >= F.lit(start[:7])) & (F.col(ts) >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.where((F.col("event_month") <= F.lit(end[:7])) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    return df.drop("event_month")
