"""Promotion-to-conversion funnel (A5-A8): did users who received a boost
create funds, upgrade them, and contribute?"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.hotkeys import HOT_ROWS, hot_keys
from ledgerlens.plans.joins import left_join_fanout, left_join_measured
from ledgerlens.plans.lookups import LookupChecks, left_lookup

# The boost promotion's payment type and amount (USD).
BOOST_TYPE = "boost"
BOOST_AMOUNT_USD = 529
# Contribution states left out of the conversion counts.
EXCLUDED_CONTRIBUTION_STATES = ("cancelled", "edited")


def _boosts(payments_clean: DataFrame, funds_clean: DataFrame, amount_usd: int | Decimal, checks: LookupChecks | None = None) -> DataFrame:
    boosts = payments_clean.where((F.col("payment_type") == BOOST_TYPE)
                                  & (F.col("payment_amount_usd") == amount_usd))
    owners = funds_clean.select(F.col("fund_id").alias("__fund"), "fund_owner_user_id")
    return left_lookup(boosts, owners, "fund_id", "__fund", "boost_funds", checks)


def hot_boosts(payments_clean: DataFrame, funds_clean: DataFrame, amount_usd: int | Decimal = BOOST_AMOUNT_USD,
               hot_rows: int = HOT_ROWS) -> tuple[bool, list[tuple]]:
    """Whether some fund (or having none) holds more than ``hot_rows`` boost
    payments, and the owners that do."""
    rows = _boosts(payments_clean, funds_clean, amount_usd).select(F.coalesce("fund_id", F.lit(-1)).alias("fund"), "fund_owner_user_id")
    funds, owners = hot_keys(rows, ["fund"], ["fund_owner_user_id"], hot_rows=hot_rows)
    return bool(funds), owners


def boost_payments(payments_clean: DataFrame, funds_clean: DataFrame,
                   amount_usd: int | Decimal = BOOST_AMOUNT_USD, hot_fund: bool = True,
                   checks: LookupChecks | None = None) -> DataFrame:
    """A5: distinct boost payments of exactly the promotion amount with the
    fund's owner and a state: Clawed (deleted), Unconfirmed (never initiated)
    or Redeemed. The source's 'Settled' and 'Anomaly' arms come after two arms
    that test the same column for NULL and NOT NULL, so they never fire.

    The rows are dealt by all columns before the DISTINCT. Without that it would
    reuse the join's partitioning by fund, and adaptive execution could not
    split a fund (or the payments without one) that holds many of the rows.
    ``hot_fund`` says whether there may be one (see :func:`hot_boosts`).
    ``checks`` observes whether a fund id is repeated.
    """
    joined = _boosts(payments_clean, funds_clean, amount_usd, checks)
    state = (F.when(F.col("payment_deleted_at").isNotNull(), "Clawed")
             .when(F.col("payment_initiated_at").isNull(), "Unconfirmed")
             .otherwise("Redeemed"))
    out = joined.select(
        F.col("payment_created_at").alias("boost_payment_created_at"),
        "contribution_id", "fund_id", "fund_owner_user_id",
        F.col("payment_initiated_at").alias("payment_redeemed_at"),
        state.alias("boost_payment_state"),
    )
    return (out.repartition(*out.columns) if hot_fund else out).distinct()


def fund_conversion_rates(funds_clean: DataFrame) -> DataFrame:
    """Per owner, whether they have a fund and whether one of them is an
    upgraded my529 plan (plan manager my529, account number, LPOA completed).

    ``COUNT(DISTINCT x) > 0`` is "some row has x not NULL", a ``max`` of a
    boolean: one partial aggregate, no distinct-aggregation rewrite.
    """
    upgraded = ((F.col("fund_plan_manager") == "my529") & F.col("fund_account_number").isNotNull()
                & (F.col("fund_lpoa_status") == "completed"))
    return funds_clean.groupBy("fund_owner_user_id").agg(
        F.max(F.col("fund_id").isNotNull()).alias("has_funds"),
        F.max(F.coalesce(upgraded, F.lit(False)) & F.col("fund_id").isNotNull()).alias("has_my529_funds"),
    )


def contribution_conversion_rates(contributions_clean: DataFrame) -> DataFrame:
    """Per contributing owner, distinct contributions (all, recurring,
    one-time) and the recurring and one-time amounts.

    The amount columns keep the source's names but are SUMs over all joined
    rows, so a contribution repeated through duplicate contributor rows is
    counted once in the distinct counts and every time in the sums.

    Two aggregates replace the three distinct counts: first per (user,
    contribution) — which contributions were seen recurring / one-time, and
    their partial sums — then per user. Both have map-side partials, so a
    user with a large share of the rows is spread by contribution id first.
    """
    rec = F.col("contribution_is_recurring")
    amount = F.col("contribution_amount_usd")
    rows = contributions_clean.where(
        F.col("contribution_id").isNotNull()
        & ~F.col("contribution_state").isin(*EXCLUDED_CONTRIBUTION_STATES)
        & (F.col("contributor_type") == "owner"))
    per_contribution = rows.groupBy("contributor_user_id", "contribution_id").agg(
        F.max(F.coalesce(rec, F.lit(False))).alias("__seen_recurring"),
        F.max(F.coalesce(~rec, F.lit(False))).alias("__seen_onetime"),
        F.sum(F.when(rec, amount)).alias("__recurring_sum"),
        F.sum(F.when(~rec, amount)).alias("__onetime_sum"),
    )
    return per_contribution.groupBy("contributor_user_id").agg(
        F.count(F.lit(1)).alias("num_contributions"),
        F.count_if(F.col("__seen_recurring")).alias("num_contributions_recurring"),
        F.count_if(F.col("__seen_onetime")).alias("num_contributions_onetime"),
        F.sum("__recurring_sum").alias("avg_recurring_contribution_amount_usd"),
        F.sum("__onetime_sum").alias("avg_onetime_contribution_amount_usd"),
    )


def conversion_funnel(users_clean: DataFrame, boosts: DataFrame, fund_rates: DataFrame,
                      contribution_rates: DataFrame, hot: Sequence[tuple] | None = None) -> DataFrame:
    """Active non-admin users with each boost on their funds (or one row
    without), fund and contribution conversion, missing values as FALSE / 0.

    A user whose admin flag is NULL is dropped, as ``NOT NULL`` is not true.
    The two one-row-per-user relations are joined to the filtered users first,
    while a user is still one row. The boosts, which may concentrate on one
    owner, come last through the skew-safe fan-out join, so that no later join
    relies on its partitioning and adaptive execution can split it. Where ``hot``
    lists the owners with very many boosts (see :func:`hot_boosts`), those are
    joined apart and all others by one plain join.
    """
    zero = F.lit(Decimal("0.00"))
    users = users_clean.where(F.col("user_is_active") & ~F.col("user_is_admin")).select(
        "user_created_at", "user_id", "user_email")
    f = fund_rates.withColumnRenamed("fund_owner_user_id", "user_id")
    c = contribution_rates.withColumnRenamed("contributor_user_id", "user_id")
    b = boosts.select(F.col("fund_owner_user_id").alias("user_id"),
                      F.col("fund_id").alias("__boost_fund"),
                      "boost_payment_created_at", "boost_payment_state")
    rated = users.join(f, "user_id", "left").join(c, "user_id", "left")
    joined = left_join_fanout(rated, b, ["user_id"], spread_nulls_by=F.xxhash64("user_email")) if hot is None \
        else left_join_measured(rated, b, ["user_id"], hot)
    n_all = F.coalesce(F.col("num_contributions"), F.lit(0).cast("bigint"))
    n_rec = F.coalesce(F.col("num_contributions_recurring"), F.lit(0).cast("bigint"))
    n_one = F.coalesce(F.col("num_contributions_onetime"), F.lit(0).cast("bigint"))
    return joined.select(
        "user_created_at", "user_id", "user_email",
        F.col("__boost_fund").isNotNull().alias("fund_has_boost"),
        "boost_payment_created_at", "boost_payment_state",
        F.coalesce(F.col("has_funds"), F.lit(False)).alias("has_funds"),
        F.coalesce(F.col("has_my529_funds"), F.lit(False)).alias("has_my529_funds"),
        n_all.alias("num_contributions"),
        n_rec.alias("num_contributions_recurring"),
        n_one.alias("num_contributions_onetime"),
        (n_all > 0).alias("has_contributions"),
        (n_rec > 0).alias("has_contributions_recurring"),
        (n_one > 0).alias("has_contributions_onetime"),
        F.coalesce(F.col("avg_recurring_contribution_amount_usd"), zero)
        .alias("avg_recurring_contribution_amount_usd"),
        F.coalesce(F.col("avg_onetime_contribution_amount_usd"), zero)
        .alias("avg_onetime_contribution_amount_usd"),
    )
