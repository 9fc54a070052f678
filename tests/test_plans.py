"""Plan shape: no cartesian or nested-loop joins, filters reach the frames scan,
ordered scans shuffle the input once."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from meshframes.operators.scan import ordered_scan
from tests.conftest import SF_SMALL
from tools.plan_report import audit


def test_headline_plans_have_no_cartesian_joins(spark):
    q = E.queries()
    for name in ("live_types_once_hourly", "dedup_replay", "telemetry_snapshot", "source_catalog", "episodes"):
        assert audit(q[name](spark, SF_SMALL))["bad"] == [], name


def test_filters_reach_the_frames_scan(spark):
    plan = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(payload_type, [CLICK,PURCHASE,VIEW])" in plan or "In(payload_type" in plan


def test_ordered_scan_shuffles_input_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 100000).alias("ts"), "id")
    plan = ordered_scan(df, ["k"], "ts", ["id"], bucket_ms=1000, lag=["id"], running_sum={"s": F.col("id")})
    text = plan._jdf.queryExecution().executedPlan().toString()
    # the input is shuffled once on (key, bucket); the summary side ships partial aggregates
    assert "partial_max_by" in text and "partial_sum" in text
    assert len([ln for ln in text.splitlines() if "Exchange hashpartitioning(k" in ln and "_scan_bk" in ln]) <= 2
