"""The skew-safe window and join shapes equal their plain forms, including
when one key holds a third of the rows."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import funnel, revenue
from ledgerlens.plans.catalog import Workspace
from ledgerlens.plans.joins import left_join_fanout
from ledgerlens.plans.windows import lead_in_order


def _rows(n=3000, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rnd.randint(1, 200)      # user 0: a third of all rows
        month = rnd.choice([None] + list(range(1, 13)))
        attempt = None if rnd.random() < 0.2 else rnd.randint(0, 10**6)
        state = rnd.choice([None, "a", "b"])
        out.append((user, month, i, attempt, state))
    return out


def test_lead_in_order_equals_single_window(spark):
    df = spark.createDataFrame(_rows(), "user long, month int, pid long, attempt long, state string")
    # Unique order: pid is unique; buckets monotone in (month NULLS LAST, pid).
    prepared = df.select("*", F.coalesce("month", F.lit(2**31 - 1)).alias("mkey"),
                         F.floor(F.col("pid") / 64).alias("ikey"))
    values = {"next_pid": "pid", "next_attempt": "attempt", "next_state": "state", "next_month": "month"}
    got = lead_in_order(prepared, ["user"], ["mkey", "ikey"], ["pid", "attempt"], values)
    w = Window.partitionBy("user").orderBy(F.col("month").asc_nulls_last(), "pid",
                                           F.col("attempt").asc_nulls_last())
    want = df.select("*", *[F.lead(v).over(w).alias(o) for o, v in values.items()])
    cols = ["user", "month", "pid", "attempt", "state", *values]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == \
        sorted(map(tuple, want.select(cols).collect()), key=repr)


def test_left_join_fanout_equals_left_join(spark):
    one = spark.createDataFrame([(k, f"u{k}") for k in range(50)] + [(None, "nobody")], "k long, name string")
    rnd = random.Random(3)
    many = spark.createDataFrame(
        [(0 if i % 3 == 0 else rnd.choice([None] + list(range(40, 120))), i) for i in range(2000)],
        "k long, v long")
    got = left_join_fanout(one, many, ["k"]).select("k", "name", "v")
    want = one.join(many, "k", "left").select("k", "name", "v")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_hot_user_is_spread_over_partitions(spark):
    rnd = random.Random(1)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 500), rnd.randint(1, 12), i * 7, i, "s") for i in range(30000)]
    df = spark.createDataFrame(rows, "user long, month int, pid long, attempt long, state string")
    prepared = df.select("*", F.col("month").alias("mkey"), F.shiftright("pid", 10).alias("ikey"))
    previous = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lead_in_order(prepared, ["user"], ["mkey", "ikey"], ["pid", "attempt"], {"next_pid": "pid"})
        per_task = (got.where("user = 0").groupBy(F.spark_partition_id().alias("p")).count()
                    .collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", previous)
    hot_rows = sum(r["count"] for r in per_task)
    assert hot_rows == 10000
    # A plain per-user window would hold all 10,000 rows in one task.
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < hot_rows / 2


def test_lead_with_one_row_a_month_and_sparse_ids(spark):
    # Ids far apart: every row is an id bucket of its own; the month level
    # still bounds what the last window holds.
    rows = [(0, m, (m * 100 + i) << 20, i, "s") for m in range(1, 13) for i in range(40)]
    rows += [(u, m, (u * 50 + m) << 20, 0, "t") for u in range(1, 30) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "user long, month int, pid long, attempt long, state string")
    prepared = df.select("*", F.col("month").alias("mkey"), F.shiftright("pid", 16).alias("ikey"))
    got = lead_in_order(prepared, ["user"], ["mkey", "ikey"], ["pid", "attempt"], {"next_pid": "pid"})
    w = Window.partitionBy("user").orderBy("month", "pid", "attempt")
    want = df.select("*", F.lead("pid").over(w).alias("next_pid"))
    cols = ["user", "pid", "next_pid"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32"}


@pytest.fixture
def skewed(spark):
    """Broadcasts off and low thresholds, so that a hot key shows."""
    previous = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in previous.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.collect()
    text = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "simple")
    return text.split("== Initial Plan ==")[0]


def _hot(spark, n=120000, users=200):
    """n rows from 16 map tasks; a third of them have key 0."""
    return spark.range(0, n, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % users).cast("long").alias("k"), F.col("id").alias("v"))


def test_fanout_join_lets_aqe_split_the_hot_key(skewed):
    one = skewed.range(0, 200, numPartitions=4).select(
        F.col("id").alias("k"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    out = left_join_fanout(one, _hot(skewed), ["k"])
    assert "SortMergeJoin(skew=true)" in _final_plan(out)
    assert out.count() == 120000


def test_paying_users_splits_a_hot_user(skewed):
    users = skewed.range(0, 200, numPartitions=4).select(F.col("id"), F.lit("web").alias("utmSource"))
    funds = skewed.range(0, 50, numPartitions=4).select(F.col("id").alias("owner"))
    rev = _hot(skewed).select(
        F.col("k").alias("user_id"), F.lit("Tips").alias("revenue_stream"),
        F.timestamp_seconds("v").cast("timestamp_ntz").alias("payment_created_at"), F.lit(1).cast("decimal(10,2)").alias("user_revenue_usd"))
    out = revenue.paying_users(revenue.user_dimension(users, funds), rev)
    plan = _final_plan(out)
    assert "SortMergeJoin(skew=true)" in plan and "ReusedExchange" in plan


def test_conversion_funnel_splits_a_hot_owner(skewed):
    users = skewed.range(0, 200, numPartitions=4).select(
        F.lit(None).cast("timestamp_ntz").alias("user_created_at"), F.col("id").alias("user_id"), F.lit("e").alias("user_email"),
        F.lit(True).alias("user_is_active"), F.lit(False).alias("user_is_admin"))
    boosts = _hot(skewed).select(
        F.col("k").alias("fund_owner_user_id"), F.col("v").alias("fund_id"),
        F.timestamp_seconds("v").cast("timestamp_ntz").alias("boost_payment_created_at"), F.lit("Redeemed").alias("boost_payment_state"))
    ids = skewed.range(0, 100, numPartitions=4)
    rates = ids.select(F.col("id").alias("fund_owner_user_id"), F.lit(True).alias("has_funds"), F.lit(False).alias("has_my529_funds"))
    contributions = ids.select(
        F.col("id").alias("contributor_user_id"), *[F.lit(1).cast("bigint").alias(c) for c in (
            "num_contributions", "num_contributions_recurring", "num_contributions_onetime")],
        *[F.lit(1).cast("decimal(12,2)").alias(c) for c in ("avg_recurring_contribution_amount_usd", "avg_onetime_contribution_amount_usd")])
    plan = _final_plan(funnel.conversion_funnel(users, boosts, rates, contributions))
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("hot", [0, None])
def test_boost_payments_splits_a_hot_or_missing_fund(skewed, hot):
    at = F.timestamp_seconds("v").cast("timestamp_ntz")
    payments = _hot(skewed).select(
        at.alias("payment_created_at"), F.col("v").alias("contribution_id"),
        F.when(F.col("k") != 0, F.col("k")).otherwise(F.lit(hot).cast("long")).alias("fund_id"), at.alias("payment_initiated_at"),
        F.lit(None).cast("timestamp_ntz").alias("payment_deleted_at"), F.lit("boost").alias("payment_type"),
        F.lit(529).cast("decimal(10,2)").alias("payment_amount_usd"))
    funds = skewed.range(0, 200, numPartitions=4).select(F.col("id").alias("fund_id"), F.col("id").alias("fund_owner_user_id"))
    assert "SortMergeJoin(skew=true)" in _final_plan(funnel.boost_payments(payments, funds))


def test_payments_extended_joins_transactions_once(skewed):
    ws = Workspace(skewed, SMALL)
    plan = _final_plan(ws.payments_extended)
    # Payments with their newest transaction: one outer join, whose exchange the
    # inner and the anti join share.
    assert plan.count("LeftOuter") == 2  # transactions, funds
    assert "ReusedExchange" in plan
    assert plan.count("orders.parquet") == 1  # payments are read once
