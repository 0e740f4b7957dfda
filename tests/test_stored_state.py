"""Bucketed sources, stored month masks, refreshed next payments, observed
lookups, interval columns and JSON kinds."""

import datetime as dt
import itertools
import random

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ledgerlens import DEFAULT_AS_OF
from ledgerlens.functions import age_intervals, age_months, json_items
from ledgerlens.operators import churn, cleaning, cohort, funnel
from ledgerlens.plans import reports
from ledgerlens.plans.catalog import Workspace
from ledgerlens.plans.lookups import LookupChecks, RepeatedKey
from ledgerlens.sources import fixture_sources
from ledgerlens.sources.bucketed import read_bucketed, write_bucketed


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df) -> str:
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


# ---------------------------------------------------------------- bucketed sources


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path_factory.mktemp('bucketed')}'")
    write_bucketed(fixture_sources(spark, SMALL), "bucketed.", 4)
    yield read_bucketed(spark, "bucketed.")
    spark.sql("DROP DATABASE bucketed CASCADE")


@pytest.fixture
def without_broadcast(spark):
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)


def test_payment_join_of_buckets_exchanges_nothing(without_broadcast, bucketed):
    payments = cleaning.clean_payments(bucketed.payments)
    newest = churn.latest_transaction_per_payment(cleaning.clean_transactions(bucketed.transactions))
    assert "Exchange" not in plan(newest)
    joined = payments.join(newest, "payment_id", "left").select("payment_id", "payment_state", "transaction_id")
    text = plan(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text
    src = fixture_sources(without_broadcast, SMALL)
    plain = cleaning.clean_payments(src.payments).join(
        churn.latest_transaction_per_payment(cleaning.clean_transactions(src.transactions)), "payment_id", "left")
    assert rows_of(joined) == rows_of(plain.select(joined.columns))


def test_payments_extended_exchanges_payments_once_for_the_attempts(without_broadcast, bucketed):
    ws = Workspace(without_broadcast, sources=bucketed)
    text = plan(churn.payments_extended(ws.payments, ws.latest_transactions, ws.card_ach, ws.funds, hot=[]))
    for key in ("payment_id", "paymentID"):
        assert f"hashpartitioning({key}" not in text


def test_derived_payment_columns_equal_the_clean_ones(spark):
    payments = Workspace(spark, SMALL).payments
    derived = cleaning.payment_derived()
    again = payments.drop(*derived).withColumns(derived).select(*payments.columns)
    assert again.schema == payments.schema
    assert rows_of(again) == rows_of(payments)


def test_payments_extended_exchanges_neither_derived_columns_nor_attempts_by_fund(without_broadcast):
    ws = Workspace(without_broadcast, SMALL)
    key = "spark.sql.debug.maxToStringFields"
    without_broadcast.conf.set(key, "1000")
    try:
        text = plan(churn.payments_extended(ws.payments, ws.latest_transactions, ws.card_ach, ws.funds, hot=[]))
        above, below = text.split("Join ", 1)  # the topmost join, of the attempts
        assert all(f"AS {c}#" in above and f"AS {c}#" not in below for c in cleaning.payment_derived())
        assert "__key_0#" in below.splitlines()[0]
    finally:
        without_broadcast.conf.unset(key)
    checks = LookupChecks()
    extended = churn.payments_extended(ws.payments, ws.latest_transactions, ws.card_ach, ws.funds, hot=[], checks=checks)
    assert extended.count() > ws.payments.count() == checks.verify()["payment_funds"]["rows_in"]
    assert rows_of(ws.payments_extended_measured) == rows_of(ws.payments_extended)


def test_reports_over_buckets_are_the_same(spark, bucketed):
    src = fixture_sources(spark, SMALL)
    assert rows_of(reports.churn_report(bucketed, DEFAULT_AS_OF)) == rows_of(reports.churn_report(src, DEFAULT_AS_OF))
    assert rows_of(reports.paying_users_report(bucketed)) == rows_of(reports.paying_users_report(src))


# ---------------------------------------------------------------- month masks


def test_advanced_state_equals_the_full_one_and_reads_one_month(spark):
    payments = Workspace(spark, SMALL).payments
    dates = [f"{y}-{m:02d}-15 12:00:00" for y, m in itertools.product((2021, 2022), range(1, 13))][1:18]
    state = cohort.activity_state(payments, dates[0])
    for since, as_of in zip(dates, dates[1:], strict=False):
        state = spark.createDataFrame(cohort.advance_state(state, payments, since, as_of).collect(), state.schema)
        if as_of[5:7] in ("03", "06"):
            assert rows_of(state) == rows_of(cohort.activity_state(payments, as_of))
    want = cohort.cohort_retention(cohort.cohort_counts(payments, dates[-1]))
    assert rows_of(cohort.cohort_retention(cohort.counts_from_state(state, dates[-1]))) == rows_of(want)
    recent = payments.where(F.col("payment_created_at_utc") >= F.lit(dates[-2]).cast("timestamp_ntz"))
    assert 0 < recent.count() < payments.count() / 4


def test_states_merge_in_any_order_and_grow_beyond_one_mask(spark):
    payments = Workspace(spark, SMALL).payments
    start, as_of = "2015-01-01 00:00:00", DEFAULT_AS_OF
    whole = cohort.activity_state(payments, as_of, start)
    assert whole.columns == ["user_id", "mask0", "mask1"]
    parts = [cohort.activity_state(payments.where(F.pmod("payment_id", F.lit(3)) == k), as_of, start) for k in range(3)]
    first = cohort.activity_state(payments, "2016-06-15 00:00:00", start)
    assert first.columns == ["user_id", "mask0"]
    for tables in (parts, parts[::-1], [whole, whole], [first, *parts]):
        assert rows_of(cohort.merge_states(*tables)) == rows_of(whole)
    assert rows_of(cohort.counts_from_state(whole, as_of, start)) == rows_of(cohort.cohort_counts(payments, as_of, start))


# ---------------------------------------------------------------- refreshed next payments


def test_refresh_after_late_rows_equals_a_full_run(spark):
    ws = Workspace(spark, SMALL)
    late = F.pmod(F.xxhash64("payment_id"), F.lit(40)) == 0
    moved = F.pmod(F.xxhash64("payment_id"), F.lit(97)) == 1
    early_payments = ws.payments.where(~late).withColumn("user_id", F.when(moved, F.col("user_id") + 1).otherwise(F.col("user_id")))
    few_attempts = ws.card_ach.where(F.pmod(F.xxhash64("cc_or_ach_transaction_id"), F.lit(30)) != 0)

    def next_payments(payments, attempts):
        return churn.fee_next_payment(churn.fee_payments_per_user(ws.users, payments, ws.latest_transactions, attempts, ws.funds))

    stored = spark.createDataFrame(next_payments(early_payments, few_attempts).collect(), next_payments(ws.payments, ws.card_ach).schema)
    attempted = ws.card_ach.where(F.pmod(F.xxhash64("cc_or_ach_transaction_id"), F.lit(30)) == 0).select("transaction_id")
    changed = ws.payments.where(late | moved).select("payment_id").unionByName(
        ws.transactions.join(attempted, "transaction_id", "left_semi").select("payment_id"))
    changed = changed.unionByName(changed).unionByName(spark.createDataFrame([(None,)], "payment_id long"))
    got = churn.refreshed_next_payments(stored, changed, ws.users, ws.payments, ws.transactions, ws.card_ach, ws.funds)
    want = rows_of(next_payments(ws.payments, ws.card_ach))
    assert rows_of(stored) != want and rows_of(got) == want
    untouched = churn.refreshed_next_payments(stored, changed.where("false"), ws.users, ws.payments, ws.transactions, ws.card_ach, ws.funds)
    assert rows_of(untouched) == rows_of(stored)


# ---------------------------------------------------------------- lookups


def test_repeated_and_null_fund_ids_are_observed(spark):
    ws = Workspace(spark, SMALL)
    checks = LookupChecks()
    rows = funnel.boost_payments(ws.payments, ws.funds, checks=checks)
    assert rows_of(rows) == rows_of(funnel.boost_payments(ws.payments, ws.funds))
    fine = checks.verify()["boost_funds"]
    assert fine["added"] == 0 and fine["rows_in"] > 0 and fine["lookup_rows"] == ws.funds.count()
    used = ws.payments.where("payment_type = 'boost' and payment_amount_usd = 529 and fund_id is not null").select("fund_id").first()[0]
    twice = ws.funds.unionByName(ws.funds.where(F.col("fund_id") == used)).unionByName(ws.funds.limit(3).withColumn("fund_id", F.lit(None).cast("long")))
    checks = LookupChecks()
    funnel.boost_payments(ws.payments, twice, checks=checks).collect()
    assert checks.report()["boost_funds"]["lookup_null_keys"] == 3
    with pytest.raises(RepeatedKey, match="boost_funds"):
        checks.verify()


def test_lookups_of_payments_are_observed(spark):
    ws = Workspace(spark, SMALL)
    checks = LookupChecks()
    churn.payments_extended(ws.payments, ws.latest_transactions, ws.card_ach, ws.funds, hot=[], checks=checks).count()
    report = checks.verify()
    assert set(report) == {"payment_transactions", "payment_funds"} and report["payment_transactions"]["rows_in"] == ws.payments.count()
    checks = LookupChecks()
    churn.payments_extended(ws.payments, ws.latest_transactions.unionByName(ws.latest_transactions), ws.card_ach, ws.funds, hot=[], checks=checks).collect()
    with pytest.raises(RepeatedKey, match="payment_transactions"):
        checks.verify()


# ---------------------------------------------------------------- AGE and JSON


def test_age_as_interval_is_stored_and_equals_age(spark, tmp_path):
    rnd = random.Random(8)
    moment = lambda: dt.datetime(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 9000), seconds=rnd.choice([0, rnd.randint(0, 86399)]), microseconds=rnd.choice([0, 250_000]))
    pairs = [(moment(), moment()) for _ in range(400)] + [(None, moment()), (moment(), None), (None, None)]
    pairs += [(dt.datetime(2021, 2, 28), dt.datetime(2021, 1, 31)), (dt.datetime(2024, 2, 29), dt.datetime(2023, 2, 28)), (dt.datetime(2021, 3, 1), dt.datetime(2021, 1, 31)),
              (dt.datetime(2021, 1, 31), dt.datetime(2021, 3, 1)), (dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 1))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz")
    ym, span = age_intervals("a", "b")
    df.select("i", "a", "b", ym.alias("ym"), span.alias("span")).write.parquet(str(tmp_path / "ages"))
    back = spark.read.parquet(str(tmp_path / "ages"))
    assert [f.dataType.simpleString() for f in back.schema.fields][3:] == ["interval year to month", "interval day to second"]
    got = back.select("i", F.expr("extract(year from ym) * 12 + extract(month from ym)").alias("m"), "span", age_months("a", "b").alias("old")).collect()
    con = duckdb.connect()
    for r in got:
        a, b = pairs[r.i]
        if a is None or b is None:
            assert r.m is None and r.span is None
            continue
        months, rest = con.execute("SELECT datepart('year', x) * 12 + datepart('month', x), x FROM (SELECT age(?::TIMESTAMP, ?::TIMESTAMP) AS x)", [a, b]).fetchone()
        assert r.m == months == r.old, (a, b)
        days, micros = con.execute("SELECT datepart('day', x), datepart('hour', x) * 3600000000 + datepart('minute', x) * 60000000 + datepart('microsecond', x) FROM (SELECT age(?::TIMESTAMP, ?::TIMESTAMP) AS x)", [a, b]).fetchone()
        assert r.span == dt.timedelta(days=days, microseconds=micros), (a, b, r.span)


def test_what_json_text_holds(spark):
    cases = [("[]", "array", 0), ('["a", {"b": [1, 2]}, null]', "array", 3), ('{"a": 1}', "object", 1), ("{}", "object", 1), ('"x"', "scalar", 1), ("12.5", "scalar", 1),
             ("true", "scalar", 1), ("null", "null", 0), ('["a"', "malformed", None), ("", "malformed", None), ("nonsense", "malformed", None), (None, None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    kind, n = json_items("t")
    assert [tuple(r) for r in df.select("i", kind.alias("kind"), n.alias("n")).orderBy("i").collect()] == [(i, k, m) for i, (_, k, m) in enumerate(cases)]


def test_backers_as_json_text_have_defined_numbers(spark):
    src = fixture_sources(spark, SMALL)
    texts = F.array(*[F.lit(x) for x in ('["a","b"]', '{"name":"a"}', "broken[", '"a"', "null")])
    funds = src.funds.withColumn("backers", F.element_at(texts, (F.pmod("id", F.lit(5)) + 1).cast("int")))
    got = cleaning.clean_funds(funds, DEFAULT_AS_OF).select("fund_id", "num_fund_backers").collect()
    assert {(r.fund_id % 5, r.num_fund_backers) for r in got} == {(0, 2), (1, 1), (2, None), (3, 1), (4, 0)}
