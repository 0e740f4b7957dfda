"""Cleaning operators: one narrow projection per source table.

They rename to snake_case, convert cents to exact decimal currency, shift UTC
timestamps to the fixed PST offset and derive the class labels. Each is a
single ``select`` (plus the contributor-contribution join), so Catalyst prunes
every column a later operator does not read straight down to the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import (
    age_parts, as_of_lit, collapse_blanks, concat_pg, date_to_pst, json_items, to_pst, usd, usd_or_zero,
)
from ledgerlens.plans.hotkeys import HOT_ROWS, hot_keys
from ledgerlens.plans.joins import left_join_fanout, left_join_measured

# Payment type lists of the payment method classes.
LEGACY_TYPES = ("authorize-net", "uesp")
OPERATIONAL_TYPES = ("migration-to-my529", "scholarshare", "voluntary-fee",
                     "rollover-earnings", "rollover-contribution")
CARD_TYPES = ("stripe", "stripecard")

# User ids and e-mail patterns that mark staff accounts.
ADMIN_USER_IDS = (57193, 545, 45080, 40000, 2000000)
ADMIN_EMAIL_PATTERNS = ("%support@%", "%backer.com%")

# Sign-up dates (PST) that close the legacy and subscription eras.
LEGACY_ERA_END = "2020-07-01 00:00:00"
SUBSCRIPTION_ERA_END = "2021-11-24 00:00:00"

# Fund description templates (ILIKE patterns) and their labels,
# in the order they are tested.
DESCRIPTION_TEMPLATES = (
    ("%with your help%", "with your help..."),
    ("%backer is a smart way to save for college by inviting family and friends to contribute%",
     "backer is a smart way..."),
    ("%ahoy there!%", "ahoy there..."),
    ("%we hope to provide%with an opportunity to pursue the education%", "we hope to provide..."),
    ("%dear all%i%d like to invite you to contribute to %", "dear all..."),
    ("%i%m super excited to tell you about a new fund we set up for%college education%", "hi friend..."),
)

# Balance bands, upper bound in USD (exclusive) and label.
BALANCE_BANDS = (
    (100, "01: $1-$99"),
    (500, "02: $100-$499"),
    (1000, "03: $500-$999"),
    (5000, "04: $1,000-$4,999"),
    (10000, "05: $5,000-$9,999"),
    (15000, "06: $10,000-$14,999"),
    (50000, "07: $15,000-$49,999"),
)
ZERO_BAND = "00: $0"
TOP_BAND = (50000, "08: $50,000+")

# Source and output names of timestamps.
PAYMENT_ACH_TIMESTAMPS = (
    ("initiatedAt", "payment_initiated_at"),
    ("pullSettledAt", "payment_pull_settled_at"),
    ("pushedAt", "payment_pushed_at"),
    ("pushSettledAt", "payment_push_settled_at"),
    ("settledAt", "payment_settled_at"),
    ("refundedAt", "payment_refunded_at"),
    ("cancelRequestedAt", "payment_cancel_requested_at"),
    ("cancelledAt", "payment_cancelled_at"),
)


def payment_method_type(ptype: Column) -> Column:
    """Legacy / Operational / ACH / Credit Card, else NULL."""
    return (F.when(ptype.isin(*LEGACY_TYPES), "Legacy")
            .when(ptype.isin(*OPERATIONAL_TYPES), "Operational")
            .when(ptype.like("ach%"), "ACH")
            .when(ptype.isin(*CARD_TYPES), "Credit Card"))


def payment_is_for(ptype: Column, contribution_id: Column) -> Column:
    """What the payment pays for."""
    return (F.when(ptype == "voluntary-fee", "Subscription Fee")
            .when(contribution_id.isNotNull(), "Contribution Payment")
            .otherwise("Unknown"))


def clean_payments(payments: DataFrame) -> DataFrame:
    """Payments with USD amounts, PST and UTC dates and class labels."""
    p = F.col
    cols = [
        p("id").alias("payment_id"),
        p("ownerId").alias("user_id"),
        p("fundID").alias("fund_id"),
        p("contributionID").alias("contribution_id"),
        p("migratedWithPayment").alias("payment_migrated_with_payment"),
        usd_or_zero("amount").alias("payment_amount_usd"),
        usd_or_zero("processingFee").alias("payment_processing_fee_usd"),
        usd_or_zero("subscriptionFee").alias("payment_subscription_fee_usd"),
        usd_or_zero("tip").alias("payment_tip_usd"),
        to_pst("createdAt").alias("payment_created_at"),
        date_to_pst("transactionDate").alias("payment_transaction_date"),
        date_to_pst("dueDate").alias("payment_due_date"),
        to_pst("updatedAt").alias("payment_updated_at"),
        to_pst("deletedAt").alias("payment_deleted_at"),
        p("createdAt").alias("payment_created_at_utc"),
        F.to_date("transactionDate").alias("payment_transaction_date_utc"),
        F.to_date("dueDate").alias("payment_due_date_utc"),
        p("updatedAt").alias("payment_updated_at_utc"),
        p("deletedAt").alias("payment_deleted_at_utc"),
    ]
    cols += [to_pst(src).alias(dst) for src, dst in PAYMENT_ACH_TIMESTAMPS]
    cols += [p(src).alias(dst + "_utc") for src, dst in PAYMENT_ACH_TIMESTAMPS]
    cols += [
        p("type").alias("payment_type"),
        p("bankAccountId").alias("payment_bank_account_id"),
        p("creditCardId").alias("payment_credit_card_id"),
        payment_method_type(p("type")).alias("payment_method_type"),
        payment_is_for(p("type"), p("contributionID")).alias("payment_is_for"),
        p("retries").alias("payment_retries"),
        p("settlementMethod").alias("payment_settlement_method"),
        p("state").alias("payment_state"),
    ]
    return payments.select(*cols)


# UTC columns of clean payments (times, and days), each with a PST
# column of the same name without "_utc".
_PAYMENT_TIMES_UTC = ("payment_created_at_utc", "payment_updated_at_utc", "payment_deleted_at_utc",
                      *(dst + "_utc" for _, dst in PAYMENT_ACH_TIMESTAMPS))
_PAYMENT_DAYS_UTC = ("payment_transaction_date_utc", "payment_due_date_utc")


def payment_derived() -> dict[str, Column]:
    """Columns of :func:`clean_payments` that follow from its other columns. An
    operator may leave them out of its exchanges and compute them again."""
    return {
        **{c.removesuffix("_utc"): to_pst(c) for c in _PAYMENT_TIMES_UTC},
        **{c.removesuffix("_utc"): date_to_pst(c) for c in _PAYMENT_DAYS_UTC},
        "payment_method_type": payment_method_type(F.col("payment_type")),
        "payment_is_for": payment_is_for(F.col("payment_type"), F.col("contribution_id")),
    }


def fund_description_class(description: Column) -> Column:
    """Template label, else the trimmed lower-case text."""
    out = None
    for pattern, label in DESCRIPTION_TEMPLATES:
        cond = description.ilike(pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.trim(F.lower(description)))


def balance_band(balance_cents: Column) -> Column:
    """S2d: balance band label; negatives fall into the first non-zero band."""
    usd_value = usd(balance_cents)
    out = F.when(usd(F.coalesce(balance_cents, F.lit(0))) == 0, ZERO_BAND)
    for bound, label in BALANCE_BANDS:
        out = out.when(usd_value < bound, label)
    return out.when(usd_value >= TOP_BAND[0], TOP_BAND[1])


def full_name(*parts) -> Column:
    """NULL-safe concatenation with blanks collapsed and trimmed."""
    spaced = []
    for i, part in enumerate(parts):
        if i:
            spaced.append(F.lit(" "))
        spaced.append(part)
    return collapse_blanks(concat_pg(*spaced))


# Source and output names of timestamps.
FUND_TIMESTAMPS = (
    ("createdAt", "fund_created_at"),
    ("updatedAt", "fund_updated_at"),
    ("deletedAt", "fund_deleted_at"),
    ("abandonedAt", "fund_abandoned_at"),
    ("establishedAt", "fund_established_at"),
    ("fundedAt", "fund_funded_at"),
    ("firstOneTimePaymentSettledAt", "first_fund_onetime_payment_settled_at"),
    ("firstRecurringPaymentSettledAt", "first_fund_recurring_payment_settled_at"),
    ("firstFamilyFundOn", "first_family_fund_on"),
    ("firstFamilyPaymentOn", "first_family_payment_on"),
    ("upgradeStartedAt", "my529_upgrade_started_at"),
    ("upgradeEstablishedAt", "my529_upgrade_established_at"),
)


def clean_funds(funds: DataFrame, as_of: str) -> DataFrame:
    """Funds with beneficiary names and age, description class, PST dates,
    upgrade flags, balance band, backers and plan details.

    The interval-typed age of the source is reported as integer years and
    months only (interval columns cannot leave the JVM).
    """
    f = F.col
    years, months = age_parts(as_of_lit(as_of), f("dob"))
    json_backers = isinstance(funds.schema["backers"].dataType, T.StringType)
    cols = [
        f("id").alias("fund_id"),
        f("uuid").alias("fund_uuid"),
        f("first").alias("beneficiary_first_name"),
        f("middle").alias("beneficiary_middle_name"),
        f("last").alias("beneficiary_last_name"),
        full_name(f("first"), f("last")).alias("beneficiary_full_name"),
        full_name(f("first"), f("middle"), f("last")).alias("beneficiary_full_name_middle"),
        f("dob").alias("beneficiary_dob"),
        years.alias("beneficiary_age_years"),
        months.alias("beneficiary_age_months"),
        f("photo").alias("fund_photo"),
        f("handle").alias("fund_handle"),
        fund_description_class(f("description")).alias("fund_description"),
    ]
    cols += [to_pst(src).alias(dst) for src, dst in FUND_TIMESTAMPS]
    cols += [
        f("upgradeStartedAt").isNotNull().alias("my529_upgrade_started_at_set"),
        f("upgradeEstablishedAt").isNotNull().alias("my529_upgrade_established_at_set"),
        f("fundName").alias("fund_name"),
        f("owner").alias("fund_owner_user_id"),
        usd("collegeSavingsBalance").alias("fund_balance_usd"),
        balance_band(f("collegeSavingsBalance")).alias("fund_balance_group"),
        f("status").alias("fund_status"),
        f("lpoaStatus").alias("fund_lpoa_status"),
        f("statusReason").alias("fund_status_reason"),
        f("accountNumber").alias("fund_account_number"),
        usd("feeBalance").alias("fee_balance_usd"),
        f("pricing").alias("fund_pricing"),
        f("gender").alias("fund_gender"),
        (f("status") != "inactive").alias("fund_is_active"),
        f("coverUrl").alias("fund_cover_photo"),
        # Stored as an array or as JSON text, in which a lone object or scalar
        # is one backer and broken text has no number.
        (f("backers") if json_backers else F.to_json(f("backers"))).alias("fund_backers"),
        (json_items(f("backers"))[1] if json_backers else F.array_size(f("backers"))).alias("num_fund_backers"),
        f("fromGift").isNotNull().alias("fund_is_from_gift"),
        f("fromGift").alias("from_gift_id"),
        f("planId").alias("fund_plan_id"),
        f("plan").alias("fund_plan_type"),
        f("programManager").alias("fund_plan_manager"),
        f("portfolio").alias("fund_plan_investment_portfolio"),
        f("expectedDob").alias("fund_expected_dob"),
        f("prebirth").alias("fund_prebirth_status"),
    ]
    return funds.select(*cols)


def user_is_admin(admin: Column, user_id: Column, email: Column, test: Column,
                  admin_ids=ADMIN_USER_IDS, email_patterns=ADMIN_EMAIL_PATTERNS) -> Column:
    """Three-valued OR of the admin signals (NULL when none is TRUE and
    one is NULL)."""
    out = admin | user_id.isin(*admin_ids)
    for pattern in email_patterns:
        out = out | email.ilike(pattern)
    return out | test


def user_era(created_pst: Column) -> Column:
    """S3d: legacy / subscription / backer2 by PST sign-up time."""
    return (F.when(created_pst < F.lit(LEGACY_ERA_END).cast("timestamp_ntz"), "legacy")
            .when(created_pst < F.lit(SUBSCRIPTION_ERA_END).cast("timestamp_ntz"), "subscription")
            .otherwise("backer2"))


def clean_users(users: DataFrame, as_of: str, admin_ids=ADMIN_USER_IDS,
                admin_email_patterns=ADMIN_EMAIL_PATTERNS) -> DataFrame:
    """S3: users with name, age, PST dates, admin/active/foundation flags,
    fee in USD, UTM fields and era. The password hash is not carried."""
    u = F.col
    years, months = age_parts(as_of_lit(as_of), u("dob"))
    created_pst = to_pst("createdAt")
    return users.select(
        u("id").alias("user_id"),
        u("uuid").alias("user_uuid"),
        u("email").alias("user_email"),
        concat_pg(u("firstName"), F.lit(" "), u("lastName")).alias("user_full_name"),
        u("firstName").alias("user_first_name"),
        u("lastName").alias("user_last_name"),
        u("streetAddress").alias("user_street_address"),
        u("zipCode").alias("user_zip_code"),
        u("city").alias("user_city"),
        u("state").alias("user_state"),
        u("dob").alias("user_dob"),
        u("photo").alias("user_photo"),
        years.alias("user_age_years"),
        months.alias("user_age_months"),
        u("gender").alias("user_gender"),
        created_pst.alias("user_created_at"),
        to_pst("updatedAt").alias("user_updated_at"),
        to_pst("deletedAt").alias("user_deleted_at"),
        user_is_admin(u("admin"), u("id"), u("email"), u("test"),
                      admin_ids, admin_email_patterns).alias("user_is_admin"),
        u("status").alias("user_status"),
        u("statusReason").alias("user_status_reason"),
        ((u("status") == "active") | u("status").isNull()).alias("user_is_active"),
        u("pricing").alias("user_pricing"),
        usd("voluntaryFee").alias("user_voluntary_fee_usd"),
        u("exemptFromFee").alias("user_exempt_from_fee"),
        u("bankAccountID").alias("user_bank_account_id"),
        u("creditCardID").alias("user_credit_card_id"),
        u("ccStripeCustomerID").alias("user_cc_stripe_customer_id"),
        F.coalesce(u("utmSource") == "foundation", F.lit(False)).alias("user_from_foundation"),
        u("utmSource").alias("user_utm_source"),
        u("utmMedium").alias("user_utm_medium"),
        u("utmCampaign").alias("user_utm_campaign"),
        user_era(created_pst).alias("user_era"),
        u("currentFundDraftId").alias("user_current_fund_draft_id"),
        u("variant").alias("user_variant"),
    )


# Contribution states that are not active.
INACTIVE_CONTRIBUTION_STATES = ("cancelled", "invalid", "edited")


def hot_contributions(contributions: DataFrame, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """(user, fund) pairs with more than ``hot_rows`` contributions."""
    return hot_keys(contributions, ["userID", "collegeFundID"], hot_rows=hot_rows)[0]


def clean_contributions(contributors: DataFrame, contributions: DataFrame, hot: Sequence[tuple] | None = None) -> DataFrame:
    """Every contributor with each of its contributions to the same fund
    (LEFT JOIN on user and fund; contributors without one are kept).

    One (user, fund) pair may own a large share of the contributions, and the
    contributions are the non-preserved side, which adaptive execution cannot
    split; the join therefore goes through the skew-safe fan-out form, or, where
    ``hot`` lists such pairs (see :func:`hot_contributions`), treats those apart.
    """
    c = contributors.select(
        F.col("userID").alias("__user"), F.col("fundID").alias("__fund"),
        *[F.col(n).alias(f"c_{n}") for n in ("id", "userID", "createdAt", "updatedAt", "deletedAt",
                                            "type", "relationship", "fundID")])
    cc = contributions.select(
        F.col("userID").alias("__user"), F.col("collegeFundID").alias("__fund"),
        *[F.col(n).alias(f"cc_{n}") for n in contributions.columns
          if n not in ("userID", "collegeFundID")])
    keys = ["__user", "__fund"]
    joined = left_join_fanout(c, cc, keys, spread_nulls_by=F.col("c_id")) if hot is None else left_join_measured(c, cc, keys, hot)
    return joined.select(
        F.col("c_id").alias("contributor_id"),
        F.col("c_userID").alias("contributor_user_id"),
        to_pst("c_createdAt").alias("contributor_created_at"),
        to_pst("c_updatedAt").alias("contributor_updated_at"),
        to_pst("c_deletedAt").alias("contributor_deleted_at"),
        F.col("c_type").alias("contributor_type"),
        F.col("c_relationship").alias("contributor_relationship"),
        to_pst("cc_createdAt").alias("contribution_created_at"),
        to_pst("cc_updatedAt").alias("contribution_updated_at"),
        to_pst("cc_deletedAt").alias("contribution_deleted_at"),
        F.col("c_fundID").alias("fund_id"),
        F.col("cc_id").alias("contribution_id"),
        F.col("cc_originalContributionId").alias("contribution_original_id"),
        F.col("cc_state").alias("contribution_state"),
        F.col("cc_frequency").alias("contribution_frequency"),
        F.col("cc_variant").alias("contribution_variant"),
        F.col("cc_createdAsStarterGift").alias("contribution_created_at_starter_gift"),
        (~F.col("cc_state").isin(*INACTIVE_CONTRIBUTION_STATES)).alias("contribution_is_active"),
        (F.col("cc_frequency") != "onetime").alias("contribution_is_recurring"),
        usd("cc_amount").alias("contribution_amount_usd"),
        usd("cc_tip").alias("contribution_tip_usd"),
        usd("cc_processingFee").alias("contribution_processing_fee_usd"),
        F.col("cc_bankAccountID").alias("contribution_bank_account_id"),
        F.col("cc_creditCardID").alias("contribution_credit_card_id"),
        F.col("cc_stripeSubscriptionID").alias("contribution_stripe_subscription_id"),
        F.col("cc_recipientName").alias("contribution_recipient_name"),
        F.col("cc_recipientParentName").alias("contribution_recipient_parent_name"),
        F.col("cc_recipientMessage").alias("contribution_recipient_message"),
        F.col("cc_recipientEmailAddress").alias("contribution_recipient_email"),
    )


def clean_transactions(transactions: DataFrame) -> DataFrame:
    """Transactions with PST dates."""
    t = F.col
    return transactions.select(
        t("id").alias("transaction_id"),
        t("paymentID").alias("payment_id"),
        t("type").alias("transaction_type_detail"),
        t("state").alias("transaction_state"),
        to_pst("createdAt").alias("transaction_created_at"),
        to_pst("updatedAt").alias("transaction_updated_at"),
        date_to_pst("date").alias("transaction_date"),
        to_pst("settledAt").alias("transaction_settled_at"),
    )


def card_ach_transactions(stripe_transactions: DataFrame, ach_transactions: DataFrame) -> DataFrame:
    """Card and ACH attempts in one relation (UNION ALL, typed NULL
    padding for the ACH-only columns); an attempt succeeded when it carries no
    error code."""
    card = stripe_transactions.select(
        F.lit("Credit Card Transaction").alias("transaction_type"),
        to_pst("createdAt").alias("cc_or_ach_created_at"),
        F.col("transactionId").alias("transaction_id"),
        F.col("id").alias("cc_or_ach_transaction_id"),
        F.col("declineCode").alias("cc_or_ach_error_code"),
        usd("amount").alias("transaction_amount_usd"),
        F.lit(None).cast("string").alias("ach_file_id"),
        F.lit(None).cast("string").alias("ach_transaction_routing_number"),
        F.col("declineCode").isNull().alias("cc_or_ach_transaction_succeeded"),
    )
    ach = ach_transactions.select(
        F.lit("ACH Transaction").alias("transaction_type"),
        to_pst("createdAt").alias("cc_or_ach_created_at"),
        F.col("transactionID").alias("transaction_id"),
        F.col("id").alias("cc_or_ach_transaction_id"),
        F.col("returnCode").alias("cc_or_ach_error_code"),
        usd("amount").alias("transaction_amount_usd"),
        F.col("achFileID").cast("string").alias("ach_file_id"),
        F.col("routingNumber").cast("string").alias("ach_transaction_routing_number"),
        F.col("returnCode").isNull().alias("cc_or_ach_transaction_succeeded"),
    )
    return card.unionByName(ach)
