"""Revenue ledger by stream and revenue per user.

Revenue is exact decimal currency throughout; a payment that contributes to
several streams yields one ledger row per stream, and NULL amounts stay in the
ledger (SUM ignores them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import to_pst, usd
from ledgerlens.plans.joins import left_join_fanout

# Ledger stream names.
SUBSCRIPTION_FEES = "Subscription Fees"
TIPS = "Tips"
PROCESSING_FEES = "Processing Fees"
BACKER_PAYOUTS = "Backer Payouts"
# Payment states that book subscription fees, and the state that
# books tips and processing fees.
FEE_STATES = ("initiated", "settled")
SETTLED = "settled"
# Fixed value: the user whose affiliate commissions are not revenue.
EXCLUDED_COMMISSION_USER = 1

LEDGER_COLUMNS = ("revenue_stream", "payment_created_at", "user_id", "fund_id", "revenue_usd")


def _stream_rules():
    ptype, state = F.col("type"), F.col("state")
    return (
        (SUBSCRIPTION_FEES, (ptype == "voluntary-fee") & state.isin(*FEE_STATES), "amount"),
        (TIPS, state == SETTLED, "tip"),
        (PROCESSING_FEES, state == SETTLED, "processingFee"),
    )


def revenue_from_payments(payments: DataFrame) -> DataFrame:
    """The payment ledger with three streams.

    Reads payments once and turns each row into one candidate row per stream
    with the built-in ``stack`` generator, keeping the candidates whose stream
    condition holds. Only the states that some stream accepts are read, a
    plain-column predicate that reaches the parquet scan.
    """
    base = payments.where(F.col("state").isin(*FEE_STATES))
    common = [to_pst("createdAt").alias("payment_created_at"),
              F.col("ownerId").alias("user_id"), F.col("fundID").alias("fund_id")]
    rules = _stream_rules()
    args = [F.lit(len(rules))]
    for name, cond, amount in rules:
        args += [F.lit(name), F.coalesce(cond, F.lit(False)), usd(amount)]
    stacked = base.select(*common, F.stack(*args).alias("revenue_stream", "__books", "revenue_usd"))
    return stacked.where(F.col("__books")).select(*LEDGER_COLUMNS)


def ledger_user_ids(payments: DataFrame, affiliate_links: DataFrame, affiliate_commissions: DataFrame,
                    excluded_user: int = EXCLUDED_COMMISSION_USER) -> DataFrame:
    """``user_id`` of every ledger row (A1), without its amounts: the keys of
    :func:`user_revenue` from a scan of three payment columns."""
    books = F.lit(False)
    for _, cond, _ in _stream_rules():
        books = books | F.coalesce(cond, F.lit(False))
    payers = payments.where(F.col("state").isin(*FEE_STATES)).where(books).select(F.col("ownerId").alias("user_id"))
    paid = revenue_from_commissions(affiliate_links, affiliate_commissions, excluded_user).select("user_id")
    return payers.unionByName(paid)


def revenue_from_commissions(affiliate_links: DataFrame, affiliate_commissions: DataFrame,
                             excluded_user: int = EXCLUDED_COMMISSION_USER) -> DataFrame:
    """Described affiliate commissions, except the excluded user's, booked
    as 'Backer Payouts' at the link's creation time.

    The source writes a LEFT JOIN whose WHERE clause rejects the NULL-extended
    rows, i.e. an inner join; the inner join also lets adaptive execution split
    a link with very many commissions.
    """
    ac = affiliate_commissions.where(F.col("description").isNotNull()
                                     & (F.col("userId") != excluded_user))
    joined = affiliate_links.alias("al").join(
        ac.alias("ac"), F.col("al.id") == F.col("ac.affiliateLinkId"), "inner")
    return joined.select(
        F.lit(BACKER_PAYOUTS).alias("revenue_stream"),
        to_pst("al.createdAt").alias("payment_created_at"),
        F.col("al.userId").alias("user_id"),
        F.col("ac.fundVoucherId").alias("fund_id"),
        F.col("ac.state").alias("commission_state"),
        usd("ac.payout").alias("revenue_usd"),
    )


def revenue_by_stream(payment_ledger: DataFrame, commission_ledger: DataFrame) -> DataFrame:
    """A1: both ledgers with the five common columns (UNION ALL)."""
    return payment_ledger.select(*LEDGER_COLUMNS).unionByName(commission_ledger.select(*LEDGER_COLUMNS))


def user_dimension(users: DataFrame, funds: DataFrame) -> DataFrame:
    """A2: distinct (user, UTM source, owns at least one fund).

    The fund owners are de-duplicated before the join (partial aggregate), so
    the join cannot fan out; the DISTINCT then runs on data already
    partitioned by user id and needs no further exchange.
    """
    owners = funds.select(F.col("owner").alias("id")).where(F.col("id").isNotNull()).distinct() \
        .withColumn("is_owner", F.lit(True))
    joined = users.select("id", "utmSource").join(owners, "id", "left")
    return joined.select(
        F.col("id").alias("user_id"), F.col("utmSource").alias("utm_source"),
        F.coalesce(F.col("is_owner"), F.lit(False)).alias("is_owner"),
    ).distinct()


def user_revenue(ledger: DataFrame) -> DataFrame:
    """A3: revenue per (user, exact payment time, stream); partial sums run on
    the map side."""
    return ledger.groupBy("user_id", "payment_created_at", "revenue_stream").agg(
        F.sum("revenue_usd").alias("user_revenue_usd"))


def paying_users(dimension: DataFrame, revenue: DataFrame, revenue_users: DataFrame | None = None) -> DataFrame:
    """A4: every user with each of their revenue groups; users without revenue
    are kept once with NULL revenue columns. ``revenue_users`` (see
    :func:`ledger_user_ids`) spares the search for users without revenue the
    second read of the amounts."""
    joined = left_join_fanout(dimension, revenue, ["user_id"], spread_nulls_by=F.xxhash64("utm_source", "is_owner"), many_keys=revenue_users)
    return joined.select(
        "user_id", "is_owner", "utm_source", "revenue_stream", "payment_created_at",
        F.coalesce(F.col("utm_source") == "foundation", F.lit(False)).alias("is_foundation"),
        "user_revenue_usd",
    )
