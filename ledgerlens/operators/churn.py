"""Month-over-month churn of subscription-fee payments.

Plan notes for scale:

* A9 keeps the newest transaction per payment with ``row_number() == 1``;
  Spark plans it as a partial ``WindowGroupLimit`` before the exchange, so a
  payment with very many transactions ships one row per map task.
* The report only reads subscription-fee payments (category 'operational',
  the first arm of A11, is exactly ``payment_type = 'voluntary-fee'``). That
  predicate is applied to the payments before any join, where it can reach the
  scan; Catalyst cannot derive it from a filter on the computed category.
* The joins of A10 are LEFT joins with the payments as the preserved side.
  The newest transaction and the fund are unique per key; the card/ACH
  attempts are not, so that join uses the skew-safe fan-out form, whose two
  branches share one exchange of payments with their newest transaction and
  fund. It comes last, and payment columns that follow from others (PST times)
  are computed after it, so that no exchange carries them.
* A16's LEAD per user is computed in three levels (see
  :func:`ledgerlens.plans.windows.lead_in_order`) so that one user with a
  large share of all payments does not end up in a single window task.
* Both protections cost time where no key is hot. The report measures hot
  transactions and payers first (:func:`hot_transactions`, :func:`hot_payers`)
  and protects those alone; callers that name none protect every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import as_of_lit, month_start
from ledgerlens.operators.cleaning import payment_derived
from ledgerlens.plans.hotkeys import HOT_ROWS, hot_keys
from ledgerlens.plans.joins import left_join_fanout, left_join_measured
from ledgerlens.plans.lookups import LookupChecks, left_lookup
from ledgerlens.plans.windows import lead_in_order, lead_measured

# Transaction types that are not the payment's own transfer.
SIDE_TRANSACTION_TYPES = ("ach-push-tip", "ach-push-fee")
# Workflow states of a successful payment, and of one that did
# not go through, as the churn rules test them.
SUCCESS_STATES = ("stripe completed", "ach completed")
UNSUCCESSFUL_STATES = ("cancelled", "returned", "refunded")
#: Payment ids are grouped in ranges of 2**16 within a month by default. Set
#: it so that a range holds some thousand of a hot user's payments.
PAYMENT_ID_BUCKET_BITS = 16


def latest_transaction_per_payment(transactions_clean: DataFrame) -> DataFrame:
    """Per payment, its newest transaction that is not a tip or fee push.

    Newest means ``transaction_created_at`` descending with NULLs first (a
    transaction without a creation time counts as newest); equal times are
    broken by the higher transaction id, so the choice is deterministic. Rank 1
    is kept, which Spark turns into a partial top-1 before the shuffle.
    """
    cols = ("transaction_id", "transaction_created_at", "transaction_state",
            "transaction_type_detail", "transaction_settled_at")
    w = Window.partitionBy("payment_id").orderBy(
        F.col("transaction_created_at").desc_nulls_first(), F.col("transaction_id").desc())
    rows = transactions_clean.where(~F.col("transaction_type_detail").isin(*SIDE_TRANSACTION_TYPES))
    return (rows.withColumn("__rank", F.row_number().over(w))
            .where(F.col("__rank") == 1)
            .select("payment_id", *cols))


def payment_category(ptype: Column, manager: Column, lpoa: Column) -> Column:
    """Operational / bill.com / cma / my529 / anomaly, first match wins."""
    return (F.when(ptype == "voluntary-fee", "operational")
            .when(manager == "cyp", "bill.com")
            .when((manager == "safe") | (lpoa != "completed") | lpoa.isNull(), "cma")
            .when((manager == "my529") | (lpoa == "completed"), "my529")
            .otherwise("anomaly"))


def cma_subtype(ptype: Column, manager: Column, lpoa: Column) -> Column:
    """NULL unless the payment is a CMA payment; then cma-safe,
    cma-my529 or anomaly (arm order as in the source)."""
    not_cma = (ptype == "voluntary-fee") | (manager == "cyp") | ((manager == "my529") | (lpoa == "completed"))
    return (F.when(not_cma, F.lit(None).cast("string"))
            .when(manager == "safe", "cma-safe")
            .when((manager == "my529") & ((lpoa != "completed") | lpoa.isNull()), "cma-my529")
            .otherwise("anomaly"))


def workflow_state(ptype: Column, pstate: Column, tstate: Column, card: Column, bank: Column,
                   pull: Column, push: Column, settled: Column) -> Column:
    """Payment workflow state from payment and transaction state, the
    instrument and which of (pull-settled, push-settled, settled) are set.
    Thirteen arms in order, then the catch-all."""
    either = lambda *states: pstate.isin(*states) | tstate.isin(*states)
    fee = ptype == "voluntary-fee"
    fee_ok = fee & pstate.isin("settled", "initiated")
    card_mismatch = ((pull.isNull() & push.isNotNull() & settled.isNull())
                     | (pull.isNotNull() & push.isNull() & settled.isNotNull()))
    none_set = pull.isNull() & push.isNull() & settled.isNull()
    ach_mismatch = ((pull.isNull() & push.isNull() & settled.isNotNull())
                    | (pull.isNull() & push.isNotNull()))
    return (F.when(either("failed", "returned"), "failed/returned")
            .when(either("refunded"), "refunded")
            .when(either("cancelled"), "cancelled")
            .when(fee_ok & card.isNotNull(), "stripe completed")
            .when(fee_ok & bank.isNotNull(), "ach completed")
            .when(fee, "voluntary fee anomaly")
            .when(card.isNotNull() & card_mismatch, "data error - stripe")
            .when(card.isNotNull() & either("settled"), "stripe completed")
            .when(card.isNotNull(), "stripe completed")
            .when(bank.isNotNull() & none_set & (pstate != "settled") & (tstate != "settled"),
                  "pull pending")
            .when(bank.isNotNull() & ach_mismatch, "data error - ach")
            .when(bank.isNotNull(), "ach completed")
            .when(either("settled"), "ach completed")
            .otherwise("data anomaly - unaccounted for"))


def cancel_issue_flag(ptype: Column, pstate: Column, error_code: Column) -> Column:
    """The attempt counts as a cancellation issue (three-valued)."""
    stopped = pstate.isin("cancelled", "failed")
    ach = (ptype == "ach") & (~stopped | (stopped & error_code.isNotNull()))
    card = (ptype == "stripe") & ~stopped & error_code.isNull()
    return ach | card


# Payment columns of the extended relation.
_PAYMENT_COLUMNS = (
    "payment_id", "user_id", "fund_id", "fund_plan_manager", "fund_lpoa_status", "contribution_id",
    "payment_amount_usd", "payment_processing_fee_usd", "payment_subscription_fee_usd", "payment_tip_usd",
    "payment_created_at", "payment_transaction_date", "payment_due_date", "payment_updated_at",
    "payment_deleted_at", "payment_created_at_utc", "payment_transaction_date_utc",
    "payment_due_date_utc", "payment_updated_at_utc", "payment_deleted_at_utc",
    "payment_initiated_at", "payment_pull_settled_at", "payment_pushed_at", "payment_push_settled_at",
    "payment_settled_at", "payment_refunded_at", "payment_cancel_requested_at", "payment_cancelled_at",
    "payment_initiated_at_utc", "payment_pull_settled_at_utc", "payment_pushed_at_utc",
    "payment_push_settled_at_utc", "payment_settled_at_utc", "payment_refunded_at_utc",
    "payment_cancel_requested_at_utc", "payment_cancelled_at_utc",
    "payment_type", "payment_method_type", "payment_is_for", "payment_bank_account_id",
    "payment_credit_card_id", "payment_retries", "payment_settlement_method", "payment_state",
    "transaction_id", "transaction_state", "transaction_type_detail", "transaction_created_at",
    "transaction_settled_at",
    "cc_ach_transaction_type", "cc_or_ach_created_at", "cc_or_ach_transaction_id",
    "cc_or_ach_error_code", "cc_or_ach_transaction_amount_usd", "ach_file_id",
    "ach_transaction_routing_number", "cc_or_ach_transaction_succeeded",
)


def hot_transactions(card_ach: DataFrame, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """Transactions with more than ``hot_rows`` card/ACH attempts."""
    return hot_keys(card_ach, ["transaction_id"], hot_rows=hot_rows)[0]


def hot_payers(payments_clean: DataFrame, fee_payments: DataFrame, transactions: Sequence[tuple],
               hot_rows: int = HOT_ROWS) -> list[tuple]:
    """Users with more than ``hot_rows`` subscription-fee payments. A hot
    transaction gives one payment very many rows; where there is one, the joined
    rows are counted instead of the payments."""
    fees = payments_clean.where(F.col("payment_type") == "voluntary-fee")
    return hot_keys(fee_payments if transactions else fees, ["user_id"], hot_rows=hot_rows)[0]


def payments_extended(payments_clean: DataFrame, latest_transactions: DataFrame,
                      card_ach: DataFrame, funds_clean: DataFrame,
                      hot: Sequence[tuple] | None = None, checks: LookupChecks | None = None) -> DataFrame:
    """A10 (with A11-A14): each payment with its newest transaction, every
    card/ACH attempt of that transaction (one row per attempt, payments
    without attempts kept once) and its fund's plan manager and LPOA status.
    ``hot`` lists the transactions with very many attempts, where known; without
    it any transaction may be one. ``checks`` observes whether a payment has
    several newest transactions or a fund id is repeated."""
    attempts = card_ach.select(
        "transaction_id",
        F.col("transaction_type").alias("cc_ach_transaction_type"),
        "cc_or_ach_created_at", "cc_or_ach_transaction_id", "cc_or_ach_error_code",
        F.col("transaction_amount_usd").alias("cc_or_ach_transaction_amount_usd"),
        "ach_file_id", "ach_transaction_routing_number", "cc_or_ach_transaction_succeeded")
    funds = funds_clean.select(F.col("fund_id").alias("__fund"), "fund_plan_manager", "fund_lpoa_status")
    newest = latest_transactions.withColumnRenamed("payment_id", "__payment")
    # Three joins exchange the payments: columns that follow from others are
    # left out of them, and the fund comes before attempts multiply the rows.
    derived = payment_derived()
    with_tx = left_lookup(payments_clean.drop(*derived), newest, "payment_id", "__payment", "payment_transactions", checks)
    with_fund = left_lookup(with_tx.drop("__payment"), funds, "fund_id", "__fund", "payment_funds", checks).drop("__fund")
    # One transaction may carry very many attempts (the non-preserved side),
    # and payments without a transaction have a NULL key: the fan-out form
    # splits the first and deals the second by payment.
    if hot is None:
        attempted = left_join_fanout(with_fund, attempts, ["transaction_id"], spread_nulls_by=F.col("payment_id"))
    else:
        attempted = left_join_measured(with_fund, attempts, ["transaction_id"], hot)
    c = F.col
    return attempted.withColumns(derived).select(
        *_PAYMENT_COLUMNS,
        payment_category(c("payment_type"), c("fund_plan_manager"), c("fund_lpoa_status"))
        .alias("payment_category"),
        cma_subtype(c("payment_type"), c("fund_plan_manager"), c("fund_lpoa_status"))
        .alias("payment_category_cma_type"),
        workflow_state(c("payment_type"), c("payment_state"), c("transaction_state"),
                       c("payment_credit_card_id"), c("payment_bank_account_id"),
                       c("payment_pull_settled_at"), c("payment_push_settled_at"),
                       c("payment_settled_at")).alias("payment_workflow_state"),
        cancel_issue_flag(c("payment_type"), c("payment_state"), c("cc_or_ach_error_code"))
        .alias("payment_counts_cancel_issue"),
    )


def fee_payments_per_user(users_clean: DataFrame, payments_clean: DataFrame,
                          latest_transactions: DataFrame, card_ach: DataFrame,
                          funds_clean: DataFrame, hot: Sequence[tuple] | None = None,
                          checks: LookupChecks | None = None) -> DataFrame:
    """Subscription-fee payments (category 'operational') of known users,
    one row per attempt, with the PST month of the payment. ``hot`` and
    ``checks``: see :func:`payments_extended`."""
    fees = payments_clean.where(F.col("payment_type") == "voluntary-fee")
    extended = payments_extended(fees, latest_transactions, card_ach, funds_clean, hot, checks)
    joined = users_clean.select("user_id").join(extended, "user_id", "inner")
    return joined.select(
        "user_id", "payment_id", "transaction_id", "transaction_created_at", "payment_created_at",
        "payment_amount_usd", "cc_or_ach_transaction_id", "payment_workflow_state",
        month_start("payment_created_at").alias("payment_created_at_month"),
    )


_NEXT_VALUES = {
    "next_actual_payment_id": "payment_id",
    "next_actual_transaction_id": "transaction_id",
    "next_actual_cc_or_ach_transaction_id": "cc_or_ach_transaction_id",
    "next_actual_payment_workflow_state": "payment_workflow_state",
    "next_actual_payment_created_at_month": "payment_created_at_month",
}


def fee_next_payment(fee_payments: DataFrame, id_bits: int = PAYMENT_ID_BUCKET_BITS,
                     hot: Sequence[tuple] | None = None) -> DataFrame:
    """The expected next month and the user's next fee payment.

    The next payment is the following row per user in order of payment month
    (NULL months last), then payment id, then attempt id; the source orders by
    month only, which leaves ties between payments of one month undefined.
    Payment ids are dealt in ranges of ``2**id_bits`` within a month. ``hot``
    lists the users with very many rows, where known (see :func:`hot_payers`);
    without it any user may be one.
    """
    month = F.col("payment_created_at_month")
    prepared = fee_payments.select(
        "user_id", "payment_id", "transaction_id", "cc_or_ach_transaction_id", "payment_workflow_state",
        "payment_created_at_month",
        F.add_months(month_start("payment_created_at"), 1).cast("timestamp_ntz")
        .alias("next_expected_payment_created_at_month"),
        # Bucket keys: monotone in the LEAD order, never NULL.
        F.coalesce(F.year(month) * 12 + F.month(month), F.lit(2 ** 31 - 1)).alias("__month_key"),
        F.shiftright(F.col("payment_id"), id_bits).alias("__id_key"),
    )
    shape = (["user_id"], ["__month_key", "__id_key"], ["payment_id", "cc_or_ach_transaction_id"], _NEXT_VALUES)
    led = lead_in_order(prepared, *shape) if hot is None else lead_measured(prepared, *shape, hot)
    return led.select(
        "user_id", "payment_id", "transaction_id", "cc_or_ach_transaction_id", "payment_workflow_state",
        F.col("payment_created_at_month").alias("current_payment_created_at_month"),
        "next_expected_payment_created_at_month", *_NEXT_VALUES)


def refreshed_next_payments(stored: DataFrame, changed: DataFrame, users_clean: DataFrame, payments_clean: DataFrame,
                            transactions_clean: DataFrame, card_ach: DataFrame, funds_clean: DataFrame,
                            id_bits: int = PAYMENT_ID_BUCKET_BITS, hot: Sequence[tuple] | None = None) -> DataFrame:
    """A16 after some payments changed, from its ``stored`` result.

    ``changed`` has the payment_id of every payment that is new or gone, or whose
    row, transactions, attempts or fund changed. Only the users of those payments,
    now or in the stored result, are computed again; the rows of all others stay
    as they are, since a payment's next one is a payment of the same user. The
    other tables are given whole and joined to the touched users' payments, so
    transactions and attempts of others are dropped before they are ranked or
    joined. The churn class (A18) depends on the reporting instant and is a
    projection over the result.

    Repeated and NULL ids in ``changed`` do no harm.
    """
    ids = changed.select("payment_id").where(F.col("payment_id").isNotNull()).distinct()
    now = payments_clean.join(ids, "payment_id", "left_semi").select("user_id")
    before = stored.join(ids, "payment_id", "left_semi").select("user_id")
    touched = now.unionByName(before).where(F.col("user_id").isNotNull()).distinct()
    fees = payments_clean.where(F.col("payment_type") == "voluntary-fee").join(touched, "user_id", "left_semi")
    newest = latest_transaction_per_payment(transactions_clean.join(fees.select("payment_id"), "payment_id", "left_semi"))
    attempts = card_ach.join(newest.select("transaction_id"), "transaction_id", "left_semi")
    fresh = fee_next_payment(fee_payments_per_user(users_clean, fees, newest, attempts, funds_clean), id_bits, hot)
    return stored.join(touched, "user_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def next_expected_month(state: Column, expected: Column, next_month: Column, next_state: Column,
                        success: Sequence[str] = SUCCESS_STATES) -> Column:
    """Expected month moved to the next successful payment's month when
    it comes later (Retained keeps the expected month)."""
    next_ok = next_state.isin(*success)
    return (F.when(state.isin(*success) & (next_month == expected) & next_ok, expected)
            .when((next_month >= expected) & next_ok, next_month)
            .otherwise(expected))


def churn_label(current_month_utc: Column, month: Column, state: Column, expected: Column,
                next_month: Column, next_state: Column, success: Sequence[str] = SUCCESS_STATES,
                unsuccessful: Sequence[str] = UNSUCCESSFUL_STATES) -> Column:
    """Current Month / Retained / Resurrected / Stale / Involuntary Churn /
    Voluntary Churn / Anomaly, first match wins. ``expected`` is the plain
    expected month (not the A17 override)."""
    ok = state.isin(*success)
    next_ok = next_state.isin(*success)
    on_time = next_month == expected
    return (F.when(current_month_utc == month, "Current Month")
            .when(ok & on_time & next_ok, "Retained")
            .when(on_time & next_ok, "Resurrected")
            .when(state.isin(*unsuccessful) & (on_time | next_month.isNull())
                  & (next_state.isin(*unsuccessful) | next_state.isNull()), "Stale")
            .when(ok & on_time & next_state.isin(*unsuccessful), "Involuntary Churn")
            .when((ok & next_month.isNull()) | (ok & (next_month > expected)), "Voluntary Churn")
            .otherwise("Anomaly"))


def churn_status(next_payments: DataFrame, as_of: str, success: Sequence[str] = SUCCESS_STATES,
                 unsuccessful: Sequence[str] = UNSUCCESSFUL_STATES) -> DataFrame:
    """A18 (with A17): churn class of every subscription-fee payment attempt.
    ``success`` and ``unsuccessful`` are the workflow states that count as such.

    The current month compares against the reporting instant truncated
    without the PST shift, as the source does.
    """
    c = F.col
    expected = c("next_expected_payment_created_at_month")
    return next_payments.select(
        "user_id", "payment_id", "transaction_id", "cc_or_ach_transaction_id", "payment_workflow_state",
        "current_payment_created_at_month",
        next_expected_month(c("payment_workflow_state"), expected,
                            c("next_actual_payment_created_at_month"),
                            c("next_actual_payment_workflow_state"), success)
        .alias("next_expected_payment_created_at_month"),
        *_NEXT_VALUES,
        churn_label(month_start(as_of_lit(as_of)), c("current_payment_created_at_month"),
                    c("payment_workflow_state"), expected,
                    c("next_actual_payment_created_at_month"),
                    c("next_actual_payment_workflow_state"), success, unsuccessful).alias("churn_status"),
    )
