"""Keys measured as hot are treated apart; the rows stay the same."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens import DEFAULT_AS_OF
from ledgerlens.operators import churn, cleaning, funnel
from ledgerlens.plans import reports
from ledgerlens.plans.hotkeys import hot_keys, is_hot
from ledgerlens.plans.joins import left_join_measured
from ledgerlens.plans.windows import lead_measured
from ledgerlens.sources import fixture_sources


def plan(df) -> str:
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed(spark, n=6000):
    rnd = random.Random(2)
    rows = [((0 if i % 3 == 0 else None if i % 50 == 1 else rnd.randint(1, 300)), ("x" if i % 3 == 0 else f"f{i % 7}"), i) for i in range(n)]
    return spark.createDataFrame(rows, "k long, f string, v long").repartition(4)


def test_hot_keys_are_found_and_others_are_not(spark):
    rows = skewed(spark)
    assert hot_keys(rows, ["k"], ["k", "f"], hot_rows=500) == [[(0,)], [(0, "x")]]
    assert hot_keys(rows, ["k"], hot_rows=5000) == [[]]
    assert hot_keys(rows.where("false"), ["k"], ["k", "f"], hot_rows=0) == [[], []]
    assert hot_keys(rows.select(F.lit(None).cast("long").alias("k")), ["k"], hot_rows=0) == [[]]


def test_is_hot_is_never_null(spark):
    rows = skewed(spark)
    for keys, hot in ((["k"], [(0,)]), (["k", "f"], [(0, "x"), (9, "f1")]), (["k"], [])):
        assert rows.where(is_hot(keys, hot).isNull()).count() == 0


@pytest.mark.parametrize("hot", [[], [(0,)], [(0,), (9,), (777,)]])
def test_measured_left_join_equals_left_join(spark, hot):
    one = spark.createDataFrame([(k, f"u{k}") for k in [*range(0, 60), 777, None]], "k long, name string")
    many = skewed(spark).select("k", "v")
    want = one.join(many, "k", "left").select("k", "name", "v")
    assert rows_of(left_join_measured(one, many, ["k"], hot)) == rows_of(want)


def test_measured_left_join_on_two_keys(spark):
    many = skewed(spark)
    one = many.select("k", "f").distinct().where("k < 40 or k is null").withColumn("name", F.concat("f", F.coalesce(F.col("k").cast("string"), F.lit("-"))))
    want = one.join(many, ["k", "f"], "left").select("k", "f", "name", "v")
    assert rows_of(left_join_measured(one, many, ["k", "f"], [(0, "x")])) == rows_of(want)


def test_hot_rows_are_not_shuffled_by_their_key(spark):
    one = spark.range(100).select(F.col("id").alias("k"), F.lit("n").alias("name"))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(left_join_measured(one, skewed(spark).select("k", "v"), ["k"], [(0,)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text


@pytest.mark.parametrize("hot", [[], [(0,)]])
def test_measured_lead_equals_single_window(spark, hot):
    df = skewed(spark).where("k is not null").select("k", "f", "v", F.floor(F.col("v") / 100).alias("m"), F.shiftright("v", 4).alias("i"))
    got = lead_measured(df, ["k"], ["m", "i"], ["v"], {"next_v": "v", "next_f": "f"}, hot)
    w = Window.partitionBy("k").orderBy("v")
    want = df.select("*", F.lead("v").over(w).alias("next_v"), F.lead("f").over(w).alias("next_f"))
    assert rows_of(got) == rows_of(want)


def test_hot_user_still_goes_through_levels(spark):
    df = skewed(spark).where("k is not null").select("k", "v", F.floor(F.col("v") / 100).alias("m"))
    text = plan(lead_measured(df, ["k"], ["m"], ["v"], {"next_v": "v"}, [(0,)]))
    assert "hashpartitioning(k" in text and ", m" in text.split("hashpartitioning(k", 1)[1] and text.count("Window") > 2
    assert plan(lead_measured(df, ["k"], ["m"], ["v"], {"next_v": "v"}, [])).count("(1) Window") <= 1


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_reports_do_not_depend_on_what_counts_as_hot(spark, hot_rows):
    src = fixture_sources(spark, SMALL)
    payments, funds = cleaning.clean_payments(src.payments), cleaning.clean_funds(src.funds, DEFAULT_AS_OF)
    boosts = funnel.boost_payments(payments, funds)
    want = funnel.conversion_funnel(
        cleaning.clean_users(src.users, DEFAULT_AS_OF), boosts, funnel.fund_conversion_rates(funds),
        funnel.contribution_conversion_rates(cleaning.clean_contributions(src.contributors, src.contributions)))
    assert rows_of(reports.conversion_funnel_report(src, DEFAULT_AS_OF, hot_rows=hot_rows)) == rows_of(want)
    attempts = cleaning.card_ach_transactions(src.stripe_transactions, src.ach_transactions)
    fees = churn.fee_payments_per_user(
        cleaning.clean_users(src.users, DEFAULT_AS_OF), payments,
        churn.latest_transaction_per_payment(cleaning.clean_transactions(src.transactions)), attempts, funds)
    want = churn.churn_status(churn.fee_next_payment(fees), DEFAULT_AS_OF)
    assert rows_of(reports.churn_report(src, DEFAULT_AS_OF, hot_rows=hot_rows)) == rows_of(want)
    if hot_rows == 2:
        assert churn.hot_transactions(attempts, hot_rows) and churn.hot_payers(payments, fees, [(1,)], hot_rows)
