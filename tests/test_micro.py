"""Literal cases with hand-derived expectations (FIXTURES.md section 3)."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from builders import ACH, FUNDS, PAYMENTS, STRIPE, TRANSACTIONS, USERS, d, table, ts
from ledgerlens import DEFAULT_AS_OF
from ledgerlens.functions import age_parts, concat_pg, date_to_pst, to_pst
from ledgerlens.operators import churn, cleaning, cohort, funnel
from ledgerlens.operators.cleaning import balance_band, full_name


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_pst_is_a_fixed_offset_even_in_summer(spark):
    df = spark.createDataFrame([(ts("2021-07-01 00:30:00"),)], "t timestamp_ntz")
    assert one(df.select(to_pst("t")))[0] == ts("2021-06-30 16:30:00")


def test_date_to_pst_starts_from_utc_midnight(spark):
    df = spark.createDataFrame([(ts("2021-07-01 13:00:00"),)], "t timestamp_ntz")
    assert one(df.select(date_to_pst("t")))[0] == ts("2021-06-30 16:00:00")


@pytest.mark.parametrize("later, earlier, years, months", [
    ("2021-02-28", "2021-01-31", 0, 0),
    ("2021-03-01", "2021-01-31", 0, 1),
    ("2020-01-31", "2022-03-01", -2, -1),
    ("2022-06-20", "2005-06-20", 17, 0),
    ("2022-06-20", "2005-06-21", 16, 11),
])
def test_age_parts_follow_postgres_age(spark, later, earlier, years, months):
    df = spark.createDataFrame([(d(later), d(earlier))], "a date, b date")
    y, m = age_parts(F.col("a"), F.col("b"))
    assert tuple(one(df.select(y, m))) == (years, months)


def test_age_parts_compare_time_of_day(spark):
    df = spark.createDataFrame([(ts("2022-06-20 12:00:00"), d("2010-06-20"))], "a timestamp_ntz, b date")
    y, m = age_parts(F.col("a"), F.col("b"))
    assert tuple(one(df.select(y, m))) == (12, 0)


@pytest.mark.parametrize("first, last, expected", [
    (None, "Lee", "Lee"),
    ("A  ", "B", "A B"),
    ("a><b", "C", "ab C"),
    ("  Ann  7", None, "Ann 7"),
])
def test_fund_full_name(spark, first, last, expected):
    df = spark.createDataFrame([(first, last)], "f string, l string")
    assert one(df.select(full_name(F.col("f"), F.col("l"))))[0] == expected


def test_user_full_name_keeps_leading_blank(spark):
    df = spark.createDataFrame([(None, "x")], "f string, l string")
    assert one(df.select(concat_pg(F.col("f"), F.lit(" "), F.col("l"))))[0] == " x"


@pytest.mark.parametrize("cents, band", [
    (None, "00: $0"), (0, "00: $0"), (-500, "01: $1-$99"), (9999, "01: $1-$99"),
    (10000, "02: $100-$499"), (4999999, "07: $15,000-$49,999"), (5000000, "08: $50,000+"),
])
def test_balance_bands(spark, cents, band):
    df = spark.createDataFrame([(cents,)], "c bigint")
    assert one(df.select(balance_band(F.col("c"))))[0] == band


def test_money_stays_exact_decimal(spark):
    p = table(spark, PAYMENTS, [{"id": 1, "amount": 12345, "tip": None}])
    row = one(cleaning.clean_payments(p).select("payment_amount_usd", "payment_tip_usd"))
    assert row == (Decimal("123.45"), Decimal("0.00"))


def test_admin_flag_is_three_valued(spark):
    u = table(spark, USERS, [
        {"id": 1, "admin": None, "test": False, "email": "a@b.example", "status": "active"},
        {"id": 2, "admin": False, "test": False, "email": "x@Backer.com", "status": "active"},
        {"id": 3, "admin": False, "test": False, "email": "z@mail.example", "status": None},
        {"id": 545, "admin": None, "test": None, "email": None, "status": "active"},
    ])
    rows = {r.user_id: (r.user_is_admin, r.user_is_active)
            for r in cleaning.clean_users(u, DEFAULT_AS_OF).collect()}
    assert rows == {1: (None, True), 2: (True, True), 3: (False, True), 545: (True, True)}


def test_funnel_drops_users_whose_admin_flag_is_null(spark):
    u = cleaning.clean_users(table(spark, USERS, [
        {"id": 1, "admin": None, "test": False, "email": "a@b.example", "status": "active"},
        {"id": 2, "admin": False, "test": False, "email": "b@b.example", "status": "active"},
    ]), DEFAULT_AS_OF)
    p = cleaning.clean_payments(table(spark, PAYMENTS, []))
    f = cleaning.clean_funds(table(spark, FUNDS, []), DEFAULT_AS_OF)
    empty_contrib = spark.createDataFrame([], "contributor_user_id bigint, contribution_id bigint, "
                                              "contribution_state string, contributor_type string, "
                                              "contribution_is_recurring boolean, "
                                              "contribution_amount_usd decimal(23,2)")
    out = funnel.conversion_funnel(u, funnel.boost_payments(p, f), funnel.fund_conversion_rates(f),
                                   funnel.contribution_conversion_rates(empty_contrib))
    assert [r.user_id for r in out.collect()] == [2]


def test_description_templates_and_fallback(spark):
    f = table(spark, FUNDS, [
        {"id": 1, "description": "WITH YOUR HELP!"},
        {"id": 2, "description": "Dear all, I'd like to invite you to contribute to Ben's fund"},
        {"id": 3, "description": "  Plain Words "},
        {"id": 4, "description": None},
    ])
    rows = {r.fund_id: r.fund_description
            for r in cleaning.clean_funds(f, DEFAULT_AS_OF).collect()}
    assert rows == {1: "with your help...", 2: "dear all...", 3: "plain words", 4: None}


def test_expected_month_and_latest_transaction(spark):
    t = cleaning.clean_transactions(table(spark, TRANSACTIONS, [
        {"id": 10, "paymentID": 1, "type": "ach-pull", "state": "settled", "createdAt": ts("2021-01-01 00:00:00")},
        {"id": 11, "paymentID": 1, "type": "ach-pull", "state": "failed", "createdAt": None},
        {"id": 12, "paymentID": 1, "type": "ach-push-tip", "state": "settled", "createdAt": None},
    ]))
    latest = one(churn.latest_transaction_per_payment(t))
    assert latest.transaction_id == 11


def _fee_rows(spark, rows):
    """Subscription-fee payments for user 1 with one settled card attempt each,
    or a failed payment state."""
    payments, transactions, card = [], [], []
    for pid, created, state in rows:
        payments.append({"id": pid, "ownerId": 1, "fundID": 1, "type": "voluntary-fee",
                         "state": state, "creditCardId": 1, "createdAt": ts(created)})
        transactions.append({"id": pid * 10, "paymentID": pid, "type": "ach-pull",
                             "state": "settled" if state == "settled" else state,
                             "createdAt": ts(created)})
        card.append({"transactionId": pid * 10, "id": pid * 100, "createdAt": ts(created)})
    p = cleaning.clean_payments(table(spark, PAYMENTS, payments))
    t = churn.latest_transaction_per_payment(cleaning.clean_transactions(table(spark, TRANSACTIONS, transactions)))
    cat = cleaning.card_ach_transactions(table(spark, STRIPE, card), table(spark, ACH, []))
    f = cleaning.clean_funds(table(spark, FUNDS, [{"id": 1, "owner": 1}]), DEFAULT_AS_OF)
    u = cleaning.clean_users(table(spark, USERS, [{"id": 1}]), DEFAULT_AS_OF)
    fee = churn.fee_payments_per_user(u, p, t, cat, f)
    return {r.payment_id: r for r in churn.churn_status(churn.fee_next_payment(fee), DEFAULT_AS_OF).collect()}


def test_churn_success_then_gap_is_voluntary_churn(spark):
    out = _fee_rows(spark, [(1, "2021-01-10 12:00:00", "settled"), (2, "2021-03-10 12:00:00", "settled")])
    assert out[1].churn_status == "Voluntary Churn"
    # A17 moves the expected month to the later successful payment.
    assert out[1].next_expected_payment_created_at_month == ts("2021-03-01 00:00:00")
    assert out[2].churn_status == "Voluntary Churn"


def test_churn_failed_then_success_after_gap_is_anomaly(spark):
    out = _fee_rows(spark, [(1, "2021-01-10 12:00:00", "failed"), (2, "2021-03-10 12:00:00", "settled")])
    assert out[1].payment_workflow_state == "failed/returned"
    assert out[1].churn_status == "Anomaly"
    assert out[1].next_expected_payment_created_at_month == ts("2021-03-01 00:00:00")


def test_churn_retained_resurrected_and_current_month(spark):
    out = _fee_rows(spark, [(1, "2021-01-31 12:00:00", "settled"), (2, "2021-02-10 12:00:00", "settled"),
                            (3, "2021-03-10 12:00:00", "refunded"), (4, "2021-04-10 12:00:00", "settled"),
                            (5, "2022-06-10 12:00:00", "settled")])
    assert out[1].churn_status == "Retained"
    assert out[1].next_expected_payment_created_at_month == ts("2021-02-01 00:00:00")
    assert out[2].churn_status == "Involuntary Churn"
    assert out[3].churn_status == "Resurrected"
    assert out[5].churn_status == "Current Month"


def test_churn_failed_next_month_is_anomaly_not_involuntary(spark):
    # 'failed/returned' is never in the unsuccessful list the churn rules test.
    out = _fee_rows(spark, [(1, "2021-01-10 12:00:00", "settled"), (2, "2021-02-10 12:00:00", "returned")])
    assert out[1].churn_status == "Anomaly"


def _activity(spark, rows, as_of=DEFAULT_AS_OF):
    p = cleaning.clean_payments(table(spark, PAYMENTS, [
        {"id": i, "ownerId": owner, "contributionID": i, "state": "settled", "createdAt": ts(created)}
        for i, (owner, created) in enumerate(rows)]))
    return p


def test_every_active_month_is_a_cohort(spark):
    p = _activity(spark, [(7, "2021-01-05 12:00:00"), (7, "2021-03-05 12:00:00")])
    counts = {(r.activity.month, r.diff): r.retained
              for r in cohort.cohort_counts(p, DEFAULT_AS_OF).collect()}
    assert counts == {(1, 0): 1, (1, 2): 1, (3, 0): 1}


def test_month_with_only_ownerless_payments_has_null_rate(spark):
    p = _activity(spark, [(None, "2021-02-05 12:00:00"), (3, "2021-03-05 12:00:00")])
    rows = {(r.activity.month, r.diff): (r.retained, r.total, r.retention_rate)
            for r in cohort.cohort_retention(cohort.cohort_counts(p, DEFAULT_AS_OF)).collect()}
    assert rows == {(2, None): (0, 0, None), (3, 0): (1, 1, 1.0)}


def test_window_upper_bound_is_inclusive(spark):
    # 2022-06-01 08:00 UTC is exactly 00:00 PST on the first of the reporting month.
    p = _activity(spark, [(4, "2022-06-01 08:00:00"), (5, "2022-06-01 08:00:01")])
    users = sorted(r.user_id for r in cohort.monthly_activity(p, DEFAULT_AS_OF).collect())
    assert users == [4]


def test_window_months_bound():
    assert cohort.window_months(DEFAULT_AS_OF) == 18
    assert cohort.window_months("2020-12-31 12:00:00") == 0
    # PST shift moves 2022-07-01 03:00 UTC back into June.
    assert cohort.window_months("2022-07-01 03:00:00") == 18


def test_cohort_masks_span_several_words(spark):
    # 70 months of activity need two 62-bit words.
    p = _activity(spark, [(1, "2021-01-05 12:00:00"), (1, "2026-10-05 12:00:00")])
    as_of = "2026-11-15 12:00:00"
    counts = {(r.activity.year, r.activity.month, r.diff): r.retained
              for r in cohort.cohort_counts(p, as_of).collect()}
    assert counts == {(2021, 1, 0): 1, (2021, 1, 69): 1, (2026, 10, 0): 1}
    assert datetime(2026, 10, 1) in {r.futureActivity for r in cohort.activity_pairs(p, as_of).collect()}


def _extended(spark, payments, transactions=(), card=(), ach=(), funds=()):
    p = cleaning.clean_payments(table(spark, PAYMENTS, list(payments)))
    t = churn.latest_transaction_per_payment(cleaning.clean_transactions(table(spark, TRANSACTIONS, list(transactions))))
    cat = cleaning.card_ach_transactions(table(spark, STRIPE, list(card)), table(spark, ACH, list(ach)))
    f = cleaning.clean_funds(table(spark, FUNDS, list(funds)), DEFAULT_AS_OF)
    return churn.payments_extended(p, t, cat, f)


def test_ach_payment_without_transaction_or_times_is_ach_completed(spark):
    # Q15: 'pull pending' needs transaction_state <> 'settled', which is NULL here.
    out = one(_extended(spark, [{"id": 1, "type": "ach", "state": "initiated", "bankAccountId": 5}]))
    assert out.payment_workflow_state == "ach completed"
    assert out.payment_category == "cma"          # no fund: LPOA status IS NULL
    assert out.payment_category_cma_type == "anomaly"


def test_workflow_state_arms(spark):
    created = ts("2021-05-05 00:00:00")
    rows = _extended(spark, [
        {"id": 1, "type": "stripe", "state": "initiated", "creditCardId": 3, "pushSettledAt": created},
        {"id": 2, "type": "ach", "state": "initiated", "bankAccountId": 3},
        {"id": 3, "type": "ach", "state": "initiated", "bankAccountId": 3, "settledAt": created},
        {"id": 4, "type": "voluntary-fee", "state": "pending"},
        {"id": 5, "type": "paper", "state": "settled"},
        {"id": 6, "type": "paper", "state": "pending"},
        {"id": 7, "type": "stripe", "state": "settled", "creditCardId": 3},
    ], transactions=[{"id": 20, "paymentID": 2, "type": "ach-pull", "state": "initiated", "createdAt": created}])
    got = {r.payment_id: r.payment_workflow_state for r in rows.collect()}
    assert got == {1: "data error - stripe", 2: "pull pending", 3: "data error - ach",
                   4: "voluntary fee anomaly", 5: "ach completed",
                   6: "data anomaly - unaccounted for", 7: "stripe completed"}


def test_category_arms_follow_source_order(spark):
    rows = _extended(spark, [
        {"id": 1, "type": "ach", "fundID": 10}, {"id": 2, "type": "ach", "fundID": 11},
        {"id": 3, "type": "ach", "fundID": 12}, {"id": 4, "type": "ach", "fundID": 13},
        {"id": 5, "type": "ach", "fundID": 14},
    ], funds=[{"id": 10, "programManager": "cyp", "lpoaStatus": "pending"},
              {"id": 11, "programManager": "safe", "lpoaStatus": "completed"},
              {"id": 12, "programManager": "my529", "lpoaStatus": "pending"},
              {"id": 13, "programManager": None, "lpoaStatus": "completed"},
              {"id": 14, "programManager": "safe", "lpoaStatus": "pending"}])
    got = {r.payment_id: (r.payment_category, r.payment_category_cma_type) for r in rows.collect()}
    # Q6: 'cma-my529' is unreachable; the subtype's first arm already catches
    # my529 plans and completed LPOAs, so a completed 'safe' fund is 'cma' with
    # a NULL subtype.
    assert got == {1: ("bill.com", None), 2: ("cma", None), 3: ("cma", None), 4: ("my529", None),
                   5: ("cma", "cma-safe")}


def test_attempt_fan_out_makes_a_payment_its_own_next(spark):
    # Q17: two attempts of one payment; the first one's "next" is the payment itself,
    # in the same month, so it is no expected-month match: Anomaly.
    created = "2021-01-10 12:00:00"
    p = cleaning.clean_payments(table(spark, PAYMENTS, [
        {"id": 1, "ownerId": 1, "fundID": 1, "type": "voluntary-fee", "state": "settled",
         "creditCardId": 1, "createdAt": ts(created)}]))
    t = churn.latest_transaction_per_payment(cleaning.clean_transactions(table(spark, TRANSACTIONS, [
        {"id": 10, "paymentID": 1, "type": "ach-pull", "state": "settled", "createdAt": ts(created)}])))
    cat = cleaning.card_ach_transactions(table(spark, STRIPE, [
        {"transactionId": 10, "id": 100, "createdAt": ts(created), "declineCode": "E1"},
        {"transactionId": 10, "id": 101, "createdAt": ts(created)}]), table(spark, ACH, []))
    f = cleaning.clean_funds(table(spark, FUNDS, [{"id": 1, "owner": 1}]), DEFAULT_AS_OF)
    u = cleaning.clean_users(table(spark, USERS, [{"id": 1}]), DEFAULT_AS_OF)
    fee = churn.fee_payments_per_user(u, p, t, cat, f)
    rows = {r.cc_or_ach_transaction_id: r for r in
            churn.churn_status(churn.fee_next_payment(fee), DEFAULT_AS_OF).collect()}
    assert rows[100].next_actual_payment_id == 1
    assert rows[100].next_actual_cc_or_ach_transaction_id == 101
    assert rows[100].churn_status == "Anomaly"
    assert rows[101].next_actual_payment_id is None
    assert rows[101].churn_status == "Voluntary Churn"


def test_repeated_contributor_rows_double_sums_not_counts(spark):
    # Q18 and Q3: the "avg" columns are sums over all joined rows.
    from builders import table as mk
    contributors = mk(spark, "id bigint, userID bigint, createdAt timestamp_ntz, updatedAt timestamp_ntz, "
                             "deletedAt timestamp_ntz, type string, relationship string, fundID bigint",
                      [{"id": 1, "userID": 9, "type": "owner", "fundID": 4},
                       {"id": -2, "userID": 9, "type": "owner", "fundID": 4}])
    contributions = mk(spark, "createdAt timestamp_ntz, updatedAt timestamp_ntz, deletedAt timestamp_ntz, "
                              "id bigint, originalContributionId bigint, state string, frequency string, "
                              "variant string, createdAsStarterGift boolean, amount bigint, tip bigint, "
                              "processingFee bigint, bankAccountID bigint, creditCardID bigint, "
                              "stripeSubscriptionID string, recipientName string, recipientParentName string, "
                              "recipientMessage string, recipientEmailAddress string, userID bigint, "
                              "collegeFundID bigint",
                       [{"id": 50, "state": "active", "frequency": "monthly", "amount": 1000,
                         "userID": 9, "collegeFundID": 4},
                        {"id": 51, "state": "active", "frequency": "onetime", "amount": 250,
                         "userID": 9, "collegeFundID": 4},
                        {"id": 52, "state": "edited", "frequency": "onetime", "amount": 999,
                         "userID": 9, "collegeFundID": 4}])
    rates = one(funnel.contribution_conversion_rates(cleaning.clean_contributions(contributors, contributions)))
    assert (rates.num_contributions, rates.num_contributions_recurring, rates.num_contributions_onetime) == (2, 1, 1)
    assert rates.avg_recurring_contribution_amount_usd == Decimal("20.00")
    assert rates.avg_onetime_contribution_amount_usd == Decimal("5.00")


def test_ledger_keeps_null_amounts_and_books_three_streams(spark):
    # Q20: one settled fee payment books a fee, a tip and a processing fee;
    # a NULL amount stays as a NULL ledger row.
    from ledgerlens.operators import revenue
    p = table(spark, PAYMENTS, [
        {"id": 1, "ownerId": 2, "type": "voluntary-fee", "state": "settled", "amount": None, "tip": 100,
         "processingFee": 30, "createdAt": ts("2021-01-01 00:00:00")},
        {"id": 2, "ownerId": 2, "type": "voluntary-fee", "state": "initiated", "amount": 500,
         "createdAt": ts("2021-01-01 00:00:00")},
        {"id": 3, "ownerId": 2, "type": "ach", "state": "pending", "amount": 500},
    ])
    got = sorted(((r.revenue_stream, r.revenue_usd) for r in revenue.revenue_from_payments(p).collect()), key=repr)
    assert got == sorted([("Subscription Fees", None), ("Tips", Decimal("1.00")),
                          ("Processing Fees", Decimal("0.30")),
                          ("Subscription Fees", Decimal("5.00"))], key=repr)


def test_failed_returned_counts_as_unsuccessful_when_named(spark):
    from ledgerlens.plans.reports import churn_report  # noqa: F401  (same parameters)
    c = F.lit
    month, due = ts("2021-01-01 00:00:00"), ts("2021-02-01 00:00:00")
    args = (c(ts("2022-06-01 00:00:00")), c(month), c("ach completed"), c(due), c(due), c("failed/returned"))
    row = spark.range(1).select(
        churn.churn_label(*args).alias("default"),
        churn.churn_label(*args, unsuccessful=(*churn.UNSUCCESSFUL_STATES, "failed/returned")).alias("named")).first()
    assert (row.default, row.named) == ("Anomaly", "Involuntary Churn")


def test_backers_as_json_text(spark):
    f = table(spark, FUNDS, [{"id": 1, "description": "x"}, {"id": 2, "description": "x"}]).withColumn(
        "backers", F.when(F.col("id") == 1, '["a","b","c"]').cast("string"))
    rows = {r.fund_id: (r.fund_backers, r.num_fund_backers) for r in cleaning.clean_funds(f, DEFAULT_AS_OF).collect()}
    assert rows == {1: ('["a","b","c"]', 3), 2: (None, None)}


def test_declared_types_of_zone_aware_parquet(spark, tmp_path):
    from ledgerlens.sources import read_sources
    from ledgerlens.sources.schemas import SCHEMAS
    t = table(spark, TRANSACTIONS, [{"id": 1, "paymentID": 2, "type": "a", "state": "s", "createdAt": ts("2021-07-01 12:30:00")}])
    t.withColumn("createdAt", F.col("createdAt").cast("timestamp")).withColumn("extra", F.lit(1)) \
        .write.parquet(str(tmp_path / "transactions"))
    got = read_sources(spark, str(tmp_path)).transactions
    assert got.schema.simpleString() == SCHEMAS["transactions"].simpleString()
    assert one(got).createdAt == ts("2021-07-01 12:30:00")
    t.drop("state").write.parquet(str(tmp_path / "bad" / "transactions"))
    with pytest.raises(ValueError, match="state"):
        read_sources(spark, str(tmp_path / "bad")).transactions  # noqa: B018


def test_null_keys_of_payments_and_attempts_of_both_kinds(spark):
    payments = cleaning.clean_payments(table(spark, PAYMENTS, [
        {"id": 1, "ownerId": 1, "fundID": None, "type": "voluntary-fee", "state": "settled", "createdAt": ts("2021-01-01 00:00:00")},
        {"id": 2, "ownerId": 1, "fundID": 7, "type": "ach", "state": "settled", "createdAt": ts("2021-01-01 00:00:00")}]))
    tx = cleaning.clean_transactions(table(spark, TRANSACTIONS, [
        {"id": 5, "paymentID": 1, "type": "ach-pull", "state": "settled", "createdAt": ts("2021-01-01 00:00:00")},
        {"id": 6, "paymentID": None, "type": "ach-pull", "state": "settled", "createdAt": ts("2021-01-01 00:00:00")}]))
    attempts = cleaning.card_ach_transactions(
        table(spark, STRIPE, [{"id": 50, "transactionId": 5, "amount": 100}, {"id": 51, "transactionId": None, "amount": 1}]),
        table(spark, ACH, [{"id": 50, "transactionID": 5, "amount": 100}]))
    funds = cleaning.clean_funds(table(spark, FUNDS, [{"id": 7, "description": "x"}]), DEFAULT_AS_OF)
    got = churn.payments_extended(payments, churn.latest_transaction_per_payment(tx), attempts, funds).collect()
    assert sorted((r.payment_id, r.transaction_id, r.cc_or_ach_transaction_id) for r in got if r.transaction_id) == [(1, 5, 50), (1, 5, 50)]
    assert len({r.cc_ach_transaction_type for r in got if r.payment_id == 1}) == 2
    assert [(r.transaction_id, r.cc_or_ach_transaction_id) for r in got if r.payment_id == 2] == [(None, None)]
