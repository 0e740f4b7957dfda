"""Plan shape, invariants and label coverage."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from ledgerlens import DEFAULT_AS_OF
from ledgerlens.operators import churn, cohort, revenue
from ledgerlens.plans.catalog import QUERIES, Workspace
from ledgerlens.sources import SOURCE_TABLES, fixture_sources, read_sources


def plan(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def parquet_sources(spark):
    """The fixture source tables written as parquet, as a deployment reads them."""
    folder = tempfile.mkdtemp(prefix="ledgerlens-test-sources-")
    derived = fixture_sources(spark, SMALL)
    for name in SOURCE_TABLES:
        getattr(derived, name).write.parquet(f"{folder}/{name}")
    return read_sources(spark, folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pair_joins(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in text, node


def test_latest_transaction_uses_partial_top1(spark):
    assert "WindowGroupLimit" in plan(QUERIES["latest_transaction_per_payment"](spark, SMALL))


def test_commission_join_is_inner(spark):
    text = plan(QUERIES["revenue_from_commissions"](spark, SMALL))
    assert "Inner" in text and "LeftOuter" not in text


def test_cohort_needs_no_join(spark):
    text = plan(QUERIES["cohort_retention"](spark, SMALL))
    assert "Join" not in text
    assert "rangepartitioning" not in text


def test_filters_reach_the_parquet_scan(spark, parquet_sources):
    ws = Workspace(spark, SMALL, DEFAULT_AS_OF, sources=parquet_sources)
    cohort_plan = plan(cohort.cohort_counts(ws.payments, ws.as_of))
    assert "GreaterThanOrEqual(createdAt,2021-01-01T08:00)" in cohort_plan
    assert "LessThanOrEqual(createdAt,2022-06-01T08:00)" in cohort_plan
    ledger_plan = plan(revenue.revenue_from_payments(parquet_sources.payments))
    assert "PushedFilters: [In(state, [initiated,settled])]" in ledger_plan
    churn_plan = plan(ws.fee_payments)
    assert "EqualTo(type,voluntary-fee)" in churn_plan


def test_scans_read_only_needed_columns(spark, parquet_sources):
    ws = Workspace(spark, SMALL, DEFAULT_AS_OF, sources=parquet_sources)
    text = plan(cohort.cohort_counts(ws.payments, ws.as_of))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("amount" not in s and "tip" not in s for s in schemas)


def test_invariants_medium(spark):
    ws = Workspace(spark, MEDIUM)
    rates = cohort.cohort_retention(cohort.cohort_counts(ws.payments, ws.as_of))
    assert rates.where((F.col("diff") == 0) & (F.col("retention_rate") != 1.0)).count() == 0
    assert rates.where(F.col("retention_rate") > 1.0).count() == 0

    assert ws.churn.count() == ws.fee_payments.count()

    pay = revenue.revenue_from_payments(ws.src.payments)
    comm = revenue.revenue_from_commissions(ws.src.affiliate_links, ws.src.affiliate_commissions)
    ledger = revenue.revenue_by_stream(pay, comm)
    assert ledger.count() == pay.count() + comm.count()
    keys = revenue.ledger_user_ids(ws.src.payments, ws.src.affiliate_links, ws.src.affiliate_commissions)
    assert {r[0] for r in keys.distinct().collect()} == {r[0] for r in ledger.select("user_id").distinct().collect()}
    per_user = revenue.user_revenue(ledger)
    assert per_user.agg(F.sum("user_revenue_usd")).first()[0] == ledger.agg(F.sum("revenue_usd")).first()[0]

    latest = ws.latest_transactions
    assert latest.count() == latest.select("payment_id").distinct().count()


def test_every_reachable_label_occurs_medium(spark):
    ws = Workspace(spark, MEDIUM)

    def labels(df, col):
        return {r[0] for r in df.select(col).distinct().collect()}

    assert labels(ws.payments_extended, "payment_workflow_state") == {
        "failed/returned", "refunded", "cancelled", "stripe completed", "ach completed",
        "voluntary fee anomaly", "data error - stripe", "pull pending", "data error - ach",
        "data anomaly - unaccounted for"}
    assert labels(ws.churn, "churn_status") == {
        "Current Month", "Retained", "Resurrected", "Stale", "Involuntary Churn",
        "Voluntary Churn", "Anomaly"}
    assert labels(ws.payments, "payment_method_type") == {
        "Legacy", "Operational", "ACH", "Credit Card", None}
    assert len(labels(ws.funds, "fund_balance_group")) == 9
    assert labels(ws.payments_extended, "payment_category") >= {"operational", "bill.com", "cma", "my529"}
    from ledgerlens.operators import funnel
    assert labels(funnel.boost_payments(ws.payments, ws.funds), "boost_payment_state") == {
        "Redeemed", "Unconfirmed", "Clawed"}


def test_lead_is_partitioned_by_bucket_not_by_user(spark):
    text = plan(QUERIES["churn_status"](spark, SMALL))
    assert "hashpartitioning(user_id" in text
    exchanges = [line for line in text.splitlines() if "hashpartitioning(user_id" in line]
    # the per-row window shuffles on (user, month, id range); only the small
    # per-bucket relation is shuffled by user alone
    assert any("__month_key" in line and "__id_key" in line for line in exchanges)


def test_cohort_is_one_bit_or_aggregate(spark):
    text = plan(QUERIES["cohort_counts"](spark, SMALL))
    assert "bit_or" in text
    scans = [line for line in text.splitlines() if re.match(r"^\(\d+\) Scan parquet", line)]
    assert len(scans) == 1
