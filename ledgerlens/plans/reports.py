"""The four reports, each one call from source tables to result.

``sources`` holds the ten source tables (see :func:`ledgerlens.sources.read_sources`);
``as_of`` is the reporting instant in UTC. The churn and funnel reports first
measure which keys hold more than ``hot_rows`` rows, a small job each, and build
their plans accordingly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerlens.operators import churn, cleaning, cohort, funnel, revenue
from ledgerlens.plans.hotkeys import HOT_ROWS
from ledgerlens.sources import Sources


def paying_users_report(sources: Sources, excluded_user: int = revenue.EXCLUDED_COMMISSION_USER) -> DataFrame:
    """Every user with revenue by stream and time (A1-A4)."""
    links, commissions = sources.affiliate_links, sources.affiliate_commissions
    ledger = revenue.revenue_by_stream(
        revenue.revenue_from_payments(sources.payments),
        revenue.revenue_from_commissions(links, commissions, excluded_user))
    return revenue.paying_users(
        revenue.user_dimension(sources.users, sources.funds), revenue.user_revenue(ledger),
        revenue.ledger_user_ids(sources.payments, links, commissions, excluded_user))


def conversion_funnel_report(sources: Sources, as_of: str, boost_amount_usd: int = funnel.BOOST_AMOUNT_USD,
                             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Active users with their boosts and conversions."""
    funds = cleaning.clean_funds(sources.funds, as_of)
    payments = cleaning.clean_payments(sources.payments)
    contributions = cleaning.clean_contributions(
        sources.contributors, sources.contributions, cleaning.hot_contributions(sources.contributions, hot_rows))
    hot_fund, hot_owners = funnel.hot_boosts(payments, funds, boost_amount_usd, hot_rows)
    return funnel.conversion_funnel(
        cleaning.clean_users(sources.users, as_of), funnel.boost_payments(payments, funds, boost_amount_usd, hot_fund),
        funnel.fund_conversion_rates(funds), funnel.contribution_conversion_rates(contributions), hot_owners)


def churn_report(sources: Sources, as_of: str, success: Sequence[str] = churn.SUCCESS_STATES,
                 unsuccessful: Sequence[str] = churn.UNSUCCESSFUL_STATES,
                 id_bits: int = churn.PAYMENT_ID_BUCKET_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Month-over-month churn class of every subscription-fee payment."""
    payments = cleaning.clean_payments(sources.payments)
    attempts = cleaning.card_ach_transactions(sources.stripe_transactions, sources.ach_transactions)
    transactions = churn.hot_transactions(attempts, hot_rows)
    fees = churn.fee_payments_per_user(
        cleaning.clean_users(sources.users, as_of), payments,
        churn.latest_transaction_per_payment(cleaning.clean_transactions(sources.transactions)),
        attempts, cleaning.clean_funds(sources.funds, as_of), transactions)
    payers = churn.hot_payers(payments, fees, transactions, hot_rows)
    return churn.churn_status(churn.fee_next_payment(fees, id_bits, payers), as_of, success, unsuccessful)


def cohort_retention_report(sources: Sources, as_of: str, start: str = cohort.ACTIVITY_START,
                            states: Sequence[str] = cohort.ACTIVE_PAYMENT_STATES) -> DataFrame:
    """Monthly cohorts and their retention."""
    payments = cleaning.clean_payments(sources.payments)
    return cohort.cohort_retention(cohort.cohort_counts(payments, as_of, start, states))
