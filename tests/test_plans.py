"""Plan-shape guards: single pass over the events, pushed filters, pruned
columns, no cartesian products, no Python in SQL-expressible operators."""

import io
import re
from contextlib import redirect_stdout

import pytest

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _q(name):
    import __spark_entry__ as entry
    return entry.queries()[name]


def test_flagship_reads_each_table_once(spark):
    text = _plan(_q("weekly_features")(spark, SF_SMALL))
    scans = re.findall(r"^\(\d+\) Scan parquet", text, flags=re.M)
    assert len(scans) == 2  # orders and customer, once each
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scan_pushdown_and_pruning(spark):
    text = _plan(_q("S2_scan_events")(spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<c_custkey:bigint>" in text  # nation key not read for this projection


@pytest.mark.parametrize("name", ["J5_W8_W9_zone_features", "J7_assign_zone", "L3_risk_zones",
                                  "A9_P17_iqr_outliers", "M14_decompose_zone", "J4_fill_weeks"])
def test_no_cartesian_or_python(spark, name):
    text = _plan(_q(name)(spark, SF_SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert not re.search(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas)", text)


def test_zone_assignment_is_a_projection(spark):
    text = _plan(_q("J7_assign_zone")(spark, SF_SMALL))
    assert "Join" not in re.sub(r"Subquery.*", "", text.split("===== Subqueries =====")[0])


def test_partitioned_event_table_prunes_months(spark, tmpdir_path):
    from tremor.sources import files as FS
    from tremor.sources.views import quake_long
    FS.write_event_table(quake_long(spark, SF_SMALL), f"{tmpdir_path}/ev")
    df = FS.read_event_table(spark, f"{tmpdir_path}/ev", "1997-03-01", "1997-05-01")
    text = _plan(df)
    assert "PartitionFilters: [isnotnull(event_month" in text and "1997-03" in text
    assert "GreaterThanOrEqual(time_utc" in text  # exact bound pushed as well
    months = {r.m for r in df.selectExpr("date_format(time_utc, 'yyyy-MM') AS m").distinct().collect()}
    assert months == {"1997-03", "1997-04"}
