"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the survey inventory.

Each query builds the source tables from the driver's parquet files, runs the
operator on the whole tables and normalises the output types for comparison
(exact decimals become doubles and integers become bigints only in this last
projection).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import DEFAULT_AS_OF
from ledgerlens.operators import churn, cleaning, cohort, funnel, revenue
from ledgerlens.plans import reports
from ledgerlens.sources import Sources, fixture_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn
    return wrap


def report(df: DataFrame) -> DataFrame:
    """Final projection: decimals -> double, all integer widths -> bigint."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(field.name))
    return df.select(*cols)


class Workspace:
    """Source tables and cleaned relations for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, as_of: str = DEFAULT_AS_OF,
                 sources: Sources | None = None):
        if sources is None and sf_dir is None:
            raise ValueError("name a data folder or give the source tables")
        self.as_of = as_of
        self.src = sources if sources is not None else fixture_sources(spark, sf_dir)

    @cached_property
    def payments(self) -> DataFrame:
        return cleaning.clean_payments(self.src.payments)

    @cached_property
    def funds(self) -> DataFrame:
        return cleaning.clean_funds(self.src.funds, self.as_of)

    @cached_property
    def users(self) -> DataFrame:
        return cleaning.clean_users(self.src.users, self.as_of)

    @cached_property
    def contributions(self) -> DataFrame:
        return cleaning.clean_contributions(self.src.contributors, self.src.contributions)

    @cached_property
    def transactions(self) -> DataFrame:
        return cleaning.clean_transactions(self.src.transactions)

    @cached_property
    def card_ach(self) -> DataFrame:
        return cleaning.card_ach_transactions(self.src.stripe_transactions,
                                              self.src.ach_transactions)

    @cached_property
    def latest_transactions(self) -> DataFrame:
        return churn.latest_transaction_per_payment(self.transactions)

    @cached_property
    def payments_extended(self) -> DataFrame:
        return churn.payments_extended(self.payments, self.latest_transactions, self.card_ach,
                                       self.funds)

    @cached_property
    def payments_extended_measured(self) -> DataFrame:
        """The same rows; transactions with very many attempts are measured
        first and protected alone."""
        return churn.payments_extended(self.payments, self.latest_transactions, self.card_ach,
                                       self.funds, churn.hot_transactions(self.card_ach))

    @cached_property
    def fee_payments(self) -> DataFrame:
        return churn.fee_payments_per_user(self.users, self.payments, self.latest_transactions,
                                           self.card_ach, self.funds)

    @cached_property
    def churn(self) -> DataFrame:
        return churn.churn_status(churn.fee_next_payment(self.fee_payments), self.as_of)

    @cached_property
    def activity(self) -> DataFrame:
        return cohort.monthly_activity(self.payments, self.as_of)


# ---------------------------------------------------------------- cohort

@register("monthly_activity")
def q_monthly_activity(spark, sf_dir):
    return report(Workspace(spark, sf_dir).activity)


@register("activity_pairs")
def q_activity_pairs(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return report(cohort.activity_pairs(ws.payments, ws.as_of))


@register("cohort_counts")
def q_cohort_counts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return report(cohort.cohort_counts(ws.payments, ws.as_of))


@register("cohort_retention")
def q_cohort_retention(spark, sf_dir):
    return report(reports.cohort_retention_report(fixture_sources(spark, sf_dir), DEFAULT_AS_OF))


# ---------------------------------------------------------------- cleaning

@register("clean_payments")
def q_clean_payments(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments)


@register("payment_method")
def q_payment_method(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments.select(
        "payment_id", "payment_type", "payment_method_type"))


@register("payment_purpose")
def q_payment_purpose(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments.select(
        "payment_id", "payment_type", "contribution_id", "payment_is_for"))


@register("clean_funds")
def q_clean_funds(spark, sf_dir):
    return report(Workspace(spark, sf_dir).funds)


@register("fund_full_name")
def q_fund_full_name(spark, sf_dir):
    return report(Workspace(spark, sf_dir).funds.select(
        "fund_id", "beneficiary_first_name", "beneficiary_middle_name", "beneficiary_last_name",
        "beneficiary_full_name", "beneficiary_full_name_middle"))


@register("age_parts")
def q_age_parts(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    funds = ws.funds.select(F.lit("fund").alias("kind"), F.col("fund_id").alias("id"),
                            F.col("beneficiary_dob").alias("dob"),
                            F.col("beneficiary_age_years").alias("age_years"),
                            F.col("beneficiary_age_months").alias("age_months"))
    users = ws.users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"),
                            F.col("user_dob").alias("dob"),
                            F.col("user_age_years").alias("age_years"),
                            F.col("user_age_months").alias("age_months"))
    return report(funds.unionByName(users))


@register("fund_description")
def q_fund_description(spark, sf_dir):
    return report(Workspace(spark, sf_dir).funds.select("fund_id", "fund_description"))


@register("balance_band")
def q_balance_band(spark, sf_dir):
    return report(Workspace(spark, sf_dir).funds.select(
        "fund_id", "fund_balance_usd", "fund_balance_group"))


@register("fund_flags")
def q_fund_flags(spark, sf_dir):
    return report(Workspace(spark, sf_dir).funds.select(
        "fund_id", "my529_upgrade_started_at_set", "my529_upgrade_established_at_set",
        "fund_is_active", "fund_is_from_gift"))


@register("fund_backers")
def q_fund_backers(spark, sf_dir):
    return report(Workspace(spark, sf_dir).funds.select(
        "fund_id", "fund_backers", "num_fund_backers"))


@register("clean_users")
def q_clean_users(spark, sf_dir):
    return report(Workspace(spark, sf_dir).users)


@register("user_admin_flag")
def q_user_admin_flag(spark, sf_dir):
    return report(Workspace(spark, sf_dir).users.select("user_id", "user_email", "user_is_admin"))


@register("user_active_flag")
def q_user_active_flag(spark, sf_dir):
    return report(Workspace(spark, sf_dir).users.select("user_id", "user_status", "user_is_active"))


@register("user_foundation_flag")
def q_user_foundation_flag(spark, sf_dir):
    return report(Workspace(spark, sf_dir).users.select(
        "user_id", "user_utm_source", "user_from_foundation"))


@register("user_era")
def q_user_era(spark, sf_dir):
    return report(Workspace(spark, sf_dir).users.select("user_id", "user_created_at", "user_era"))


@register("clean_contributions")
def q_clean_contributions(spark, sf_dir):
    return report(Workspace(spark, sf_dir).contributions)


@register("clean_transactions")
def q_clean_transactions(spark, sf_dir):
    return report(Workspace(spark, sf_dir).transactions)


@register("card_ach_transactions")
def q_card_ach_transactions(spark, sf_dir):
    return report(Workspace(spark, sf_dir).card_ach)


# ---------------------------------------------------------------- revenue

def _ledgers(ws: Workspace):
    pay = revenue.revenue_from_payments(ws.src.payments)
    comm = revenue.revenue_from_commissions(ws.src.affiliate_links, ws.src.affiliate_commissions)
    return pay, comm


@register("revenue_from_payments")
def q_revenue_from_payments(spark, sf_dir):
    return report(revenue.revenue_from_payments(Workspace(spark, sf_dir).src.payments))


@register("revenue_from_commissions")
def q_revenue_from_commissions(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return report(revenue.revenue_from_commissions(ws.src.affiliate_links,
                                                   ws.src.affiliate_commissions))


@register("revenue_by_stream")
def q_revenue_by_stream(spark, sf_dir):
    return report(revenue.revenue_by_stream(*_ledgers(Workspace(spark, sf_dir))))


@register("user_dimension")
def q_user_dimension(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return report(revenue.user_dimension(ws.src.users, ws.src.funds))


@register("user_revenue")
def q_user_revenue(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return report(revenue.user_revenue(revenue.revenue_by_stream(*_ledgers(ws))))


@register("paying_users")
def q_paying_users(spark, sf_dir):
    return report(reports.paying_users_report(fixture_sources(spark, sf_dir)))


# ---------------------------------------------------------------- churn

_ATTEMPT_KEY = ("payment_id", "cc_or_ach_transaction_id")


@register("latest_transaction_per_payment")
def q_latest_transaction_per_payment(spark, sf_dir):
    return report(Workspace(spark, sf_dir).latest_transactions)


@register("payments_extended")
def q_payments_extended(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments_extended_measured)


@register("payment_category")
def q_payment_category(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments_extended_measured.select(
        *_ATTEMPT_KEY, "payment_type", "fund_plan_manager", "fund_lpoa_status", "payment_category"))


@register("cma_subtype")
def q_cma_subtype(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments_extended_measured.select(
        *_ATTEMPT_KEY, "payment_category", "payment_category_cma_type"))


@register("payment_workflow_state")
def q_payment_workflow_state(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments_extended_measured.select(
        *_ATTEMPT_KEY, "payment_state", "transaction_state", "payment_workflow_state"))


@register("cancel_issue_flag")
def q_cancel_issue_flag(spark, sf_dir):
    return report(Workspace(spark, sf_dir).payments_extended_measured.select(
        *_ATTEMPT_KEY, "payment_type", "cc_or_ach_error_code", "payment_counts_cancel_issue"))


@register("fee_payments_per_user")
def q_fee_payments_per_user(spark, sf_dir):
    return report(Workspace(spark, sf_dir).fee_payments)


@register("fee_next_payment")
def q_fee_next_payment(spark, sf_dir):
    return report(churn.fee_next_payment(Workspace(spark, sf_dir).fee_payments))


@register("next_expected_month")
def q_next_expected_month(spark, sf_dir):
    return report(Workspace(spark, sf_dir).churn.select(
        "user_id", *_ATTEMPT_KEY, "payment_workflow_state", "current_payment_created_at_month",
        "next_actual_payment_created_at_month", "next_expected_payment_created_at_month"))


@register("churn_status")
def q_churn_status(spark, sf_dir):
    return report(reports.churn_report(fixture_sources(spark, sf_dir), DEFAULT_AS_OF))


# ---------------------------------------------------------------- funnel

@register("boost_payments")
def q_boost_payments(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    return report(funnel.boost_payments(ws.payments, ws.funds))


@register("fund_conversion_rates")
def q_fund_conversion_rates(spark, sf_dir):
    return report(funnel.fund_conversion_rates(Workspace(spark, sf_dir).funds))


@register("contribution_conversion_rates")
def q_contribution_conversion_rates(spark, sf_dir):
    return report(funnel.contribution_conversion_rates(Workspace(spark, sf_dir).contributions))


@register("conversion_funnel")
def q_conversion_funnel(spark, sf_dir):
    return report(reports.conversion_funnel_report(fixture_sources(spark, sf_dir), DEFAULT_AS_OF))
