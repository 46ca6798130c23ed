"""Documents of a feed read with a quarantine for what cannot be read.

A malformed or oversized document must not turn into rows of NULLs, nor stop
the good documents beside it.  Every document is parsed once into a VARIANT;
those that are not what they should be get a reason and go to the quarantine
with their origin, the others are read.  Typed columns are taken from the
VARIANT (a value of another type is NULL), and the feature's whole
``properties`` stay with the row as VARIANT, so properties the schema does not
know are kept and can be asked for later.

Files larger than ``max_bytes`` are quarantined by their listing alone: their
content is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions.scalars import epoch_ms
from tremor.session import cut_lineage
from tremor.sources.files import GEOJSON_PROPERTIES

MAX_BYTES = 256 << 20           # largest document that one task reads

#: reasons, in the order in which they are tried
REASONS = ("too large", "empty", "not UTF-8", "not JSON", "not an object", "no features")


def read_documents(spark: SparkSession, path: str, lines: bool = False, max_bytes: int = MAX_BYTES, pattern: str = "*") -> DataFrame:
    """One row per document (a file, or with ``lines`` a line): source, bytes,
    modified, text (NULL where it is not read), document (VARIANT, NULL where
    it cannot be parsed), reason (NULL for an object)."""
    if lines:
        raw = (spark.read.option("pathGlobFilter", pattern).text(path)
               .select(F.col("_metadata.file_path").alias("source"), F.octet_length("value").cast("bigint").alias("bytes"),
                       F.col("_metadata.file_modification_time").alias("modified"), F.col("value").cast("binary").alias("content")))
        raw = raw.withColumn("content", F.when(F.col("bytes") <= max_bytes, F.col("content")))
    else:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
                 .select(F.col("path").alias("source"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content"))
        # the filter on the length reaches the source: content of larger files is never fetched
        small = files.where(F.col("bytes") <= max_bytes)
        raw = small.unionByName(files.where(F.col("bytes") > max_bytes).drop("content").withColumn("content", F.lit(None).cast("binary")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    parsed = raw.withColumn("text", text).withColumn("document", F.try_parse_json("text"))
    # of what is JSON, an object alone begins so; the schema of a whole document is not needed for that
    an_object = F.startswith(F.ltrim("text", F.lit(" \t\r\n")), F.lit("{"))
    reason = (F.when(F.col("content").isNull(), REASONS[0]).when(F.trim(F.col("content").cast("string"), F.lit(" \t\r\n")) == "", REASONS[1])
              .when(F.col("text").isNull(), REASONS[2]).when(F.col("document").isNull(), REASONS[3])
              .when(~an_object, REASONS[4]))
    return parsed.select("source", "bytes", "modified", "text", "document", reason.alias("reason"))


def with_features(documents: DataFrame) -> DataFrame:
    """Documents with ``features`` (array of VARIANT); objects without such an
    array get a reason."""
    found = F.when(F.col("reason").isNull(), F.try_variant_get("document", "$.features", "array<variant>"))
    out = documents.withColumn("features", found)
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("features").isNull(), F.lit(REASONS[5]))))


def quarantined(documents: DataFrame) -> DataFrame:
    """The documents that were not read: source, bytes, modified, reason, head
    (their first 200 characters)."""
    return documents.where(F.col("reason").isNotNull()).select("source", "bytes", "modified", "reason", F.left("text", F.lit(200)).alias("head"))


def quarantine_counts(documents: DataFrame) -> DataFrame:
    """reason, documents, bytes; ``read`` for those without a reason."""
    return documents.groupBy(F.coalesce("reason", F.lit("read")).alias("reason")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))


def write_quarantine(documents: DataFrame, place: str) -> None:
    """Appends to the quarantine table, a partition per reason."""
    quarantined(documents).write.mode("append").partitionBy("reason").parquet(place)


def feature_rows(documents: DataFrame) -> DataFrame:
    """One row per feature of the readable documents: the event columns, the
    feature's ``properties`` as VARIANT, and its source.  A feature that is not
    an object has NULLs."""
    f = documents.where(F.col("reason").isNull()).select("source", F.explode("features").alias("f"))

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("f", path, kind)

    typed = [get(f"$.properties.{p.name}", p.dataType.simpleString()).alias(p.name) for p in GEOJSON_PROPERTIES.fields if p.name not in ("time", "updated")]
    return f.select(
        get("$.id", "string").alias("id"), epoch_ms(get("$.properties.time", "bigint")).alias("time_utc"),
        epoch_ms(get("$.properties.updated", "bigint")).alias("updated_utc"), get("$.geometry.coordinates[0]", "double").alias("longitude"),
        get("$.geometry.coordinates[1]", "double").alias("latitude"), get("$.geometry.coordinates[2]", "double").alias("depth_km"),
        *typed, get("$.properties", "variant").alias("properties"), "source")


def unknown_properties(properties: str = "properties") -> Column:
    """Names and JSON texts of the properties that the schema does not know."""
    known = F.array(*[F.lit(p.name) for p in GEOJSON_PROPERTIES.fields])
    every = F.try_variant_get(properties, "$", "map<string, variant>")
    return F.transform_values(F.map_filter(every, lambda k, v: ~F.array_contains(known, k)), lambda k, v: F.to_json(v))


def read_geojson_safely(spark: SparkSession, path: str, quarantine: str | None = None, lines: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """S1 with a quarantine: the events of all readable documents of a folder;
    the others are appended to the table ``quarantine``, if one is named.  Then
    the documents are parsed once for both, and of a text its head is kept."""
    documents = with_features(read_documents(spark, path, lines, max_bytes))
    if quarantine is not None:
        head = F.when(F.col("reason").isNotNull(), F.left("text", F.lit(200)))
        documents = cut_lineage(documents.select("source", "bytes", "modified", head.alias("text"), "features", "reason"))
        write_quarantine(documents, quarantine)
    return feature_rows(documents)
