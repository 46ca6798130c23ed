"""URL rules by a sort-merge range join over reversed-host keys.

A URL's host is turned round by labels and closed by a dot
(``www.example.com`` -> ``com.example.www.``), so a rule's host and all its
subdomains are the interval of keys that begin with the rule's key.  URLs and
rules are cut into ranges of the sorted keys; a rule is sent to every range
that its interval meets.  Inside a range both are swept once in key order: a
stack holds the nested rules whose intervals are open, and of these the
longest one whose path begins the URL's path decides.

Ranges are cut at quantiles of a sample of (key, salt), so a host with any
share of the URLs is split; the sample only places the cuts.  The longest
rule is the one with the most characters of host and path together, of equal
ones the one with the longer host, then the smaller rule text.

Null URLs and URLs without ``://`` have empty host and path and fit no rule
(but one with an empty host, which fits every host).  Repeated rows and rows
without page_id are kept.  With no rules all URLs get the default verdict.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import reliable

SAMPLE_ROWS = 20_000            # keys that place the cuts
ROWS_PER_RANGE = 200_000
DEFAULT_VERDICT = "allow"

# (verdict, host, path), fixed by the task
TASK_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://``, host up to ``/ ? #``, path up to ``? #``."""
    rest = F.when(url.contains("://"), F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return (F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            F.substring(rest, F.length(host) + 1, F.length(rest)))


def host_key(host: Column) -> Column:
    """Labels turned round, each closed by a dot; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit(".")))


def _cuts(keyed: DataFrame, rows: int) -> list[str]:
    """Sorted cut points that deal the rows into ranges of about equal size."""
    ranges = -(-rows // ROWS_PER_RANGE)
    ranges = max(ranges, min(rows // 64, keyed.sparkSession.sparkContext.defaultParallelism))
    if ranges <= 1:
        return []
    part = min(1.0, SAMPLE_ROWS / rows)
    sample = sorted(r.k for r in keyed.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
                    .select("k").orderBy(F.xxhash64("k")).limit(2 * SAMPLE_ROWS).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    host, path = split_url(F.col("url").cast("string"))
    # the salt behind a character below every other one keeps a key's rows together and in one order
    urls = (pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumn("key", host_key(F.col("host")))
            .withColumn("k", F.concat("key", F.lit("\x00"), F.hex(F.xxhash64("page_id", "path")))))
    urls = reliable(urls)
    cuts = _cuts(urls, urls.count())

    known = (rules.where("host is not null and path is not null")
             .select("verdict", F.lower("host").alias("host"), "path").distinct()
             .withColumn("key", host_key(F.col("host"))))

    @F.pandas_udf("int")
    def range_of(k):
        return k.map(lambda x: bisect.bisect_right(cuts, x))

    # a rule's interval is [key, key + U+10FFFF)
    events = (urls.select(range_of("k").alias("at"), "k", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
              .union(known.withColumn("at", F.explode(F.sequence(range_of("key"), range_of(F.concat("key", F.lit("\U0010ffff"))))))
                     .select("at", F.col("key").alias("k"), F.lit(0).alias("kind"), F.lit(None).cast("bigint"), "host", "path", "verdict")))

    def sweep(batches):
        at, stack = None, []            # open rules: (key, [(rank, host, path, verdict)])
        for batch in batches:
            out = []
            for a, k, kind, page, h, p, v in zip(*(c.to_pylist() for c in batch.columns)):
                if a != at:
                    at, stack = a, []
                key = k if kind == 0 else k[:k.index("\x00")]
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(h) + len(p), len(h), h, p, v))
                    continue
                best = None
                for _, held in stack:
                    for rule in held:
                        if p.startswith(rule[3]) and (best is None or rule[:2] > best[:2] or rule[:2] == best[:2] and rule[2:] < best[2:]):
                            best = rule
                out.append((page, h, p, best[2] + best[3] if best else None, best[4] if best else default))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                                                 names=["page_id", "host", "path", "rule", "verdict"])

    return (events.repartition("at").sortWithinPartitions("at", "k", "kind")
            .mapInArrow(sweep, "page_id bigint, host string, path string, rule string, verdict string"))


TASK_SQL = """
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
q AS (SELECT page_id, regexp_extract(r, '^[^?#]*') AS r FROM p),
s AS (SELECT page_id, regexp_extract(r, '^[^/]*') AS raw, r FROM q),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(r, length(raw) + 1) AS path FROM s)
SELECT page_id, host, path,
  CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
       WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
  CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'allow'
       WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'block'
       WHEN ('.' || host) LIKE '%.net' AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block'
       ELSE 'allow' END AS verdict
FROM u
"""
