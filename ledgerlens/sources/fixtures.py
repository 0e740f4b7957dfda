"""Shape the driver's TPC-H-like tables into the ten payment-domain tables.

The source queries come without data, so each source table is derived by a fixed rule
from ``orders``, ``customer``, ``lineitem``, ``supplier`` and ``part``; the
rules are written out in FIXTURES.md and, independently, as DuckDB SQL in
``oracle/``. Everything here is narrow per-row projection except
``transactions`` (one aggregate) and the attempt ids (one ranking window), so
the derived tables scale with their inputs and keep the scans' column pruning.

Source column names keep the application's camelCase spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _plus(ts: Column, days=0, hours=0) -> Column:
    d = days if isinstance(days, Column) else F.lit(days)
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return ts + F.make_dt_interval(days=d.cast("int"), hours=h.cast("int"))


def _cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def _if(cond: Column, value) -> Column:
    return F.when(cond, value)


def _pick(key: Column, mapping: dict) -> Column:
    """CASE key WHEN k1 THEN v1 ... END (unlisted keys give NULL)."""
    out = None
    for k, v in mapping.items():
        out = (F.when(key == k, F.lit(v)) if out is None
               else out.when(key == k, F.lit(v)))
    return out


def fund_id_for_order(k: Column, cust: Column) -> Column:
    return cust * 2 + F.floor(k / 3) % 2


def payments(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    state = (F.when(status == "F", "settled").when(status == "O", "initiated")
             .when(status == "P", _pick(k % 6, {0: "cancelled", 1: "failed", 2: "refunded",
                                                3: "returned", 4: "pending"})))
    ptype = (F.when(prio.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "voluntary-fee")
             .when(prio == "4-NOT SPECIFIED", F.when(k % 2 == 0, "ach").otherwise("boost"))
             .when(prio == "5-LOW", _pick(k % 5, {0: "stripe", 1: "stripecard", 2: "uesp",
                                                  3: "rollover-earnings", 4: "paper"})))
    created = _plus(_ts("2021-01-01 00:00:00"), days=(k * 7919) % 547, hours=k % 24)
    method_slot = F.floor(k / 2) % 5
    return orders.select(
        k.alias("id"),
        F.when((k % 211 == 0) | (c % 47 == 0), F.lit(None).cast("bigint")).otherwise(c).alias("ownerId"),
        fund_id_for_order(k, c).alias("fundID"),
        F.when(k % 4 == 0, F.lit(None).cast("bigint")).otherwise(k).alias("contributionID"),
        _if(k % 41 == 0, k - 1).alias("migratedWithPayment"),
        F.when(k % 29 == 0, F.lit(None).cast("bigint"))
         .when((prio == "4-NOT SPECIFIED") & (k % 6 == 1), F.lit(52900).cast("bigint"))
         .otherwise(_cents(F.col("o_totalprice"))).alias("amount"),
        _if(k % 7 != 0, k % 500).alias("tip"),
        _if(k % 11 != 0, k % 300).alias("processingFee"),
        _if(k % 13 != 0, k % 400).alias("subscriptionFee"),
        created.alias("createdAt"),
        _plus(created, days=1).alias("transactionDate"),
        _plus(created, days=3).alias("dueDate"),
        _plus(created, days=2).alias("updatedAt"),
        _if(k % 37 == 0, _plus(created, days=9)).alias("deletedAt"),
        _if(F.floor(k / 6) % 3 != 0, _plus(created, hours=1)).alias("initiatedAt"),
        _if(F.floor(k / 16) % 2 == 1, _plus(created, days=2)).alias("pullSettledAt"),
        _if(F.floor(k / 32) % 2 == 1, _plus(created, days=3)).alias("pushedAt"),
        _if(F.floor(k / 32) % 2 == 1, _plus(created, days=4)).alias("pushSettledAt"),
        _if(F.floor(k / 64) % 2 == 1, _plus(created, days=5)).alias("settledAt"),
        _if(state == "refunded", _plus(created, days=6)).alias("refundedAt"),
        _if(state == "cancelled", _plus(created, days=7)).alias("cancelRequestedAt"),
        _if(state == "cancelled", _plus(created, days=8)).alias("cancelledAt"),
        ptype.alias("type"),
        state.alias("state"),
        _if(method_slot.isin(2, 3), c).alias("bankAccountId"),
        _if(method_slot.isin(0, 1), c).alias("creditCardId"),
        (k % 4).cast("int").alias("retries"),
        F.when(k % 2 == 0, "m0").otherwise("m1").alias("settlementMethod"),
    )


def users(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    created = _plus(_ts("2019-06-01 00:00:00"), days=(k * 37) % 1100)
    return customer.select(
        k.alias("id"),
        F.col("c_name").alias("uuid"),
        F.when(k % 97 == 0, "Support@x.example")
         .when(k % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.example"))).alias("email"),
        _if(k % 19 != 0, F.concat(F.lit("F"), k.cast("string"))).alias("firstName"),
        _if(k % 23 != 0, F.concat(F.lit("L"), k.cast("string"))).alias("lastName"),
        F.concat(k.cast("string"), F.lit(" Main St")).alias("streetAddress"),
        F.lit("94105").alias("zipCode"),
        F.lit("San Francisco").alias("city"),
        F.lit("CA").alias("state"),
        _if(k % 31 != 0, F.date_add(F.lit("1970-01-01").cast("date"), ((k * 17) % 12000).cast("int"))).alias("dob"),
        F.lit(None).cast("string").alias("photo"),
        F.lit("x").alias("passwordHash"),
        _pick(k % 3, {0: "female", 1: "male"}).alias("gender"),
        created.alias("createdAt"),
        _plus(created, days=1).alias("updatedAt"),
        _if(k % 61 == 0, _plus(created, days=2)).alias("deletedAt"),
        _if(k % 83 != 0, k % 101 == 0).alias("admin"),
        _if(k % 83 != 0, k % 103 == 0).alias("test"),
        F.when(k % 7 == 0, "inactive").when(k % 7 == 1, F.lit(None).cast("string"))
         .otherwise("active").alias("status"),
        F.lit(None).cast("string").alias("statusReason"),
        F.lit("standard").alias("pricing"),
        (k % 1000).alias("voluntaryFee"),
        (k % 50 == 0).alias("exemptFromFee"),
        _if(k % 2 == 0, k).alias("bankAccountID"),
        _if(k % 2 == 1, k).alias("creditCardID"),
        _if(k % 2 == 1, F.concat(F.lit("cus_"), k.cast("string"))).alias("ccStripeCustomerID"),
        F.when(seg == "BUILDING", "foundation").when(seg == "FURNITURE", F.lit(None).cast("string"))
         .otherwise(F.lower(seg)).alias("utmSource"),
        F.lower(seg).alias("utmMedium"),
        F.lit("spring").alias("utmCampaign"),
        _if(k % 9 == 0, k * 2).alias("currentFundDraftId"),
        F.lit("a").alias("variant"),
    )


# One description per template of the fund description classes,
# in mixed case, each matching its own template and no earlier one.
FUND_DESCRIPTIONS = {
    0: "Hello! With Your Help we can save",
    1: "BACKER is a smart way to save for college by inviting family and friends to contribute today",
    2: "Ahoy There! A new saver",
    3: "We hope to provide Sam with an opportunity to pursue the education of choice",
    4: "Dear All, I would like to invite you to contribute to the fund",
    5: "Hi! I am super excited to tell you about a new fund we set up for Max and college education",
    6: "  Custom TEXT  ",
    8: "",
}


def funds(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    seg = F.lower(F.col("c_mktsegment"))
    bal = _cents(F.col("c_acctbal"))
    created = _plus(_ts("2020-05-01 00:00:00"), days=k % 700)
    misc = _if(k % 10 == 0, _plus(created, days=6))
    none_s, none_ts = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")

    main = customer.where(k % 7 != 0).select(
        (k * 2).alias("id"), seg.alias("uuid"),
        F.concat(F.lit("  Ann  "), k.cast("string")).alias("first"),
        _if(k % 2 != 0, F.lit("M")).alias("middle"),
        _if(k % 11 != 0, F.lit("Lee")).alias("last"),
        _if(k % 29 != 0, F.date_add(F.lit("2005-01-31").cast("date"), ((k * 13) % 6000).cast("int"))).alias("dob"),
        seg.alias("photo"), seg.alias("handle"),
        _pick(k % 9, FUND_DESCRIPTIONS).alias("description"),
        created.alias("createdAt"), _plus(created, days=1).alias("updatedAt"),
        misc.alias("deletedAt"), misc.alias("abandonedAt"),
        _plus(created, days=2).alias("establishedAt"), _plus(created, days=3).alias("fundedAt"),
        misc.alias("firstOneTimePaymentSettledAt"), misc.alias("firstRecurringPaymentSettledAt"),
        misc.alias("firstFamilyFundOn"), misc.alias("firstFamilyPaymentOn"),
        _if(k % 3 == 0, _plus(created, days=4)).alias("upgradeStartedAt"),
        _if(k % 6 == 0, _plus(created, days=5)).alias("upgradeEstablishedAt"),
        seg.alias("fundName"), k.alias("owner"),
        F.when(k % 13 == 0, F.lit(None).cast("bigint")).when(k % 17 == 0, F.lit(0).cast("bigint"))
         .when(k % 4 == 0, bal * 8).when(k % 4 == 1, (bal / 10).cast("bigint"))
         .otherwise(bal).alias("collegeSavingsBalance"),
        F.when(k % 6 == 0, "inactive").when(k % 6 == 1, none_s).otherwise("active").alias("status"),
        _pick(k % 3, {0: "completed", 1: "pending"}).alias("lpoaStatus"),
        seg.alias("statusReason"),
        _if(k % 5 != 0, F.concat(F.lit("A"), k.cast("string"))).alias("accountNumber"),
        (k % 900).alias("feeBalance"), seg.alias("pricing"), seg.alias("gender"), seg.alias("coverUrl"),
        _if(k % 43 != 0, F.slice(F.array(F.lit("b1"), F.lit("b2"), F.lit("b3")), 1, (k % 4).cast("int"))).alias("backers"),
        _if(k % 8 == 0, k).alias("fromGift"),
        seg.alias("planId"), seg.alias("plan"),
        _pick(k % 4, {0: "my529", 1: "safe", 2: "cyp"}).alias("programManager"),
        seg.alias("portfolio"), seg.alias("expectedDob"), seg.alias("prebirth"),
    )
    gift_day = _ts("2021-05-01 00:00:00")
    second = customer.where(k % 5 == 0).select(
        (k * 2 + 1).alias("id"), none_s.alias("uuid"),
        F.lit("Bo").alias("first"), none_s.alias("middle"), F.lit("a><b").alias("last"),
        F.lit("2010-02-28").cast("date").alias("dob"),
        none_s.alias("photo"), none_s.alias("handle"), none_s.alias("description"),
        gift_day.alias("createdAt"), gift_day.alias("updatedAt"),
        none_ts.alias("deletedAt"), none_ts.alias("abandonedAt"),
        gift_day.alias("establishedAt"), gift_day.alias("fundedAt"),
        none_ts.alias("firstOneTimePaymentSettledAt"), none_ts.alias("firstRecurringPaymentSettledAt"),
        none_ts.alias("firstFamilyFundOn"), none_ts.alias("firstFamilyPaymentOn"),
        gift_day.alias("upgradeStartedAt"), none_ts.alias("upgradeEstablishedAt"),
        none_s.alias("fundName"), k.alias("owner"), bal.alias("collegeSavingsBalance"),
        F.lit("active").alias("status"), F.lit("completed").alias("lpoaStatus"),
        none_s.alias("statusReason"), F.concat(F.lit("B"), k.cast("string")).alias("accountNumber"),
        F.lit(0).cast("bigint").alias("feeBalance"), none_s.alias("pricing"), none_s.alias("gender"),
        none_s.alias("coverUrl"), F.array().cast("array<string>").alias("backers"),
        F.lit(None).cast("bigint").alias("fromGift"), none_s.alias("planId"), none_s.alias("plan"),
        F.lit("my529").alias("programManager"), none_s.alias("portfolio"),
        none_s.alias("expectedDob"), none_s.alias("prebirth"),
    )
    return main.unionByName(second)


def transactions(lineitem: DataFrame) -> DataFrame:
    grouped = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("min_supp"), F.min("l_shipdate").alias("first_ship"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    state = F.when(F.col("min_supp") % 10 <= 5, "settled").otherwise(
        _pick(F.col("min_supp") % 10, {6: "failed", 7: "refunded", 8: "initiated", 9: "cancelled"}))
    created = F.when((k % 53 == 0) & (n == 2), F.lit(None).cast("timestamp_ntz")).otherwise(F.col("first_ship"))
    return grouped.select(
        (k * 10 + n).alias("id"), k.alias("paymentID"),
        F.when(n == 6, "ach-push-tip").when(n == 7, "ach-push-fee").otherwise("ach-pull").alias("type"),
        state.alias("state"),
        created.alias("createdAt"),
        _plus(created, days=1).alias("updatedAt"),
        created.alias("date"),
        _if(state == "settled", _plus(created, days=2)).alias("settledAt"),
    )


def _attempts(lineitem: DataFrame) -> DataFrame:
    # Several card/ACH attempts per transaction: one per lineitem row, ranked
    # inside its (order, line) group for a unique id.
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    # The window stands alone: what is computed beside it would go through its
    # exchange as columns of their own.
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    ranked = lineitem.select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        F.row_number().over(w).alias("__rank"))
    return ranked.select(
        "l_orderkey", "l_suppkey",
        (k * 1000 + n * 100 + F.col("__rank")).alias("id"),
        (k * 10 + n).alias("tx"),
        F.col("l_shipdate").alias("createdAt"),
        _if(p % 9 == 0, F.concat(F.lit("E"), (p % 5).cast("string"))).alias("code"),
        _cents(F.col("l_extendedprice")).alias("amount"),
    )


def stripe_transactions(lineitem: DataFrame) -> DataFrame:
    a = _attempts(lineitem).where(F.col("l_orderkey") % 2 == 1)
    return a.select("createdAt", F.col("tx").alias("transactionId"), "id",
                    F.col("code").alias("declineCode"), "amount")


def ach_transactions(lineitem: DataFrame) -> DataFrame:
    a = _attempts(lineitem).where(F.col("l_orderkey") % 2 == 0)
    return a.select("createdAt", F.col("tx").alias("transactionID"), "id",
                    F.col("code").alias("returnCode"),
                    F.concat(F.lit("R"), F.col("l_suppkey").cast("string")).alias("routingNumber"),
                    "amount",
                    F.concat(F.lit("F"), (F.col("l_orderkey") % 100).cast("string")).alias("achFileID"))


def contributors(orders: DataFrame) -> DataFrame:
    base = (orders.select(F.col("o_custkey").alias("userID"),
                          fund_id_for_order(F.col("o_orderkey"), F.col("o_custkey")).alias("fundID"),
                          "o_orderkey")
            .groupBy("userID", "fundID").agg(F.min("o_orderkey").alias("k")))
    k = F.col("k")
    created = _plus(_ts("2021-01-01 00:00:00"), days=k % 300)

    def shape(ids: Column) -> list[Column]:
        return [ids.alias("id"), "userID", created.alias("createdAt"),
                _plus(created, days=1).alias("updatedAt"),
                _if(k % 10 == 0, _plus(created, days=2)).alias("deletedAt"),
                F.when(k % 3 == 1, "friend").otherwise("owner").alias("type"),
                F.when(k % 3 == 1, "family").otherwise("self").alias("relationship"),
                "fundID"]

    # Repeated (user, fund) contributor rows exist in the application data.
    return base.select(*shape(k)).unionByName(
        base.where(k % 19 == 0).select(*shape(-k - 1)))


def contributions(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    created = _plus(_ts("2021-01-01 00:00:00"), days=k % 500)
    freq = _pick(F.floor(k / 12) % 3, {0: "onetime", 1: "monthly"})
    return orders.where(k % 2 == 0).select(
        created.alias("createdAt"), _plus(created, days=1).alias("updatedAt"),
        _if(k % 10 == 0, _plus(created, days=2)).alias("deletedAt"),
        k.alias("id"), _if(k % 8 == 0, k - 2).alias("originalContributionId"),
        _pick(F.floor(k / 2) % 6, {0: "active", 1: "cancelled", 2: "edited", 3: "invalid",
                                   4: "paused"}).alias("state"),
        freq.alias("frequency"),
        F.concat(F.lit("v"), (k % 3).cast("string")).alias("variant"),
        (k % 5 == 0).alias("createdAsStarterGift"),
        _cents(F.col("o_totalprice")).alias("amount"),
        (k % 100).alias("tip"), (k % 50).alias("processingFee"),
        _if(k % 4 == 0, c).alias("bankAccountID"), _if(k % 4 == 2, c).alias("creditCardID"),
        _if(freq == "monthly", F.concat(F.lit("sub_"), k.cast("string"))).alias("stripeSubscriptionID"),
        _if(k % 6 == 0, F.lit("Kid")).alias("recipientName"),
        _if(k % 6 == 0, F.lit("Parent")).alias("recipientParentName"),
        _if(k % 6 == 0, F.lit("Enjoy")).alias("recipientMessage"),
        _if(k % 6 == 0, F.lit("p@mail.example")).alias("recipientEmailAddress"),
        c.alias("userID"), fund_id_for_order(k, c).alias("collegeFundID"),
    )


def affiliate_links(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(s.alias("id"), s.alias("userId"),
                           _plus(_ts("2021-03-01 00:00:00"), days=s % 400).alias("createdAt"))


def affiliate_commissions(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    return part.select(
        (F.floor(p / 25)).cast("bigint").alias("affiliateLinkId"),
        p.alias("fundVoucherId"),
        F.col("p_type").alias("state"),
        _cents(F.col("p_retailprice")).alias("payout"),
        _if(p % 3 != 0, F.col("p_name")).alias("description"),
        F.when(p % 10 == 0, F.lit(1).cast("bigint")).when(p % 10 == 1, F.lit(None).cast("bigint"))
         .otherwise(p % 1000).alias("userId"),
    )
