"""Nested output documents (S7) and the empty-batch contract.

A document is a header of global aggregates plus an ordered array of
records.  ``collect_list`` is used only where the array is bounded by
construction (k zones, the last 12 weeks); event-level records are
written as distributed JSON lines next to a one-row header instead of
being packed into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_records(df: DataFrame, fields: list[str], sort_keys: list[tuple[str, bool]]) -> Column:
    """Array of record structs ordered by ``sort_keys`` [(field, descending)].

    The sort key fields are placed first in a helper struct so that
    ``array_sort`` orders by them, then dropped with ``transform``.
    """
    keys = [(F.lit(0) - F.col(k) if desc else F.col(k)).alias(f"__k{i}") for i, (k, desc) in enumerate(sort_keys)]
    rec = F.struct(*keys, F.struct(*[F.col(f) for f in fields]).alias("r"))
    return F.transform(F.array_sort(F.collect_list(rec)), lambda x: x["r"])


def to_document(df: DataFrame, header: dict[str, Column], records_name: str,
                fields: list[str], sort_keys: list[tuple[str, bool]]) -> DataFrame:
    """One-row document = header aggregates + ordered record array.

    For bounded record sets only (zones, recent weeks).  An empty input still
    yields one row with an empty array (S9).
    """
    recs = F.coalesce(ordered_records(df, fields, sort_keys), F.array())
    return df.agg(*[c.alias(n) for n, c in header.items()], recs.alias(records_name))


def write_document(doc: DataFrame, path: str) -> None:
    """Write a one-row document as JSON."""
    doc.coalesce(1).write.mode("overwrite").json(path)


def write_records(header: DataFrame, records: DataFrame, path: str, order: list[Column]) -> None:
    """Unbounded documents: a one-row header and sorted records as JSON lines
    (range-partitioned sort, written in parallel)."""
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    records.orderBy(*order).write.mode("overwrite").json(f"{path}/records")
