"""DuckDB SQL for the ten source tables, written independently of the Spark
adapters from the rules in FIXTURES.md. Each entry is a CTE body over the
driver's pre-registered views (orders, customer, lineitem, supplier, part).
"""

from __future__ import annotations

TS = "TIMESTAMP"

ADAPTERS: dict[str, str] = {}

ADAPTERS["src_payments"] = """
SELECT
  k AS id,
  CASE WHEN k % 211 = 0 OR c % 47 = 0 THEN NULL ELSE c END AS "ownerId",
  c * 2 + (k // 3) % 2 AS "fundID",
  CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS "contributionID",
  CASE WHEN k % 41 = 0 THEN k - 1 END AS "migratedWithPayment",
  CASE WHEN k % 29 = 0 THEN NULL
       WHEN prio = '4-NOT SPECIFIED' AND k % 6 = 1 THEN 52900
       ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount,
  CASE WHEN k % 7 <> 0 THEN k % 500 END AS tip,
  CASE WHEN k % 11 <> 0 THEN k % 300 END AS "processingFee",
  CASE WHEN k % 13 <> 0 THEN k % 400 END AS "subscriptionFee",
  created AS "createdAt",
  created + INTERVAL 1 DAY AS "transactionDate",
  created + INTERVAL 3 DAY AS "dueDate",
  created + INTERVAL 2 DAY AS "updatedAt",
  CASE WHEN k % 37 = 0 THEN created + INTERVAL 9 DAY END AS "deletedAt",
  CASE WHEN (k // 6) % 3 <> 0 THEN created + INTERVAL 1 HOUR END AS "initiatedAt",
  CASE WHEN (k // 16) % 2 = 1 THEN created + INTERVAL 2 DAY END AS "pullSettledAt",
  CASE WHEN (k // 32) % 2 = 1 THEN created + INTERVAL 3 DAY END AS "pushedAt",
  CASE WHEN (k // 32) % 2 = 1 THEN created + INTERVAL 4 DAY END AS "pushSettledAt",
  CASE WHEN (k // 64) % 2 = 1 THEN created + INTERVAL 5 DAY END AS "settledAt",
  CASE WHEN st = 'refunded' THEN created + INTERVAL 6 DAY END AS "refundedAt",
  CASE WHEN st = 'cancelled' THEN created + INTERVAL 7 DAY END AS "cancelRequestedAt",
  CASE WHEN st = 'cancelled' THEN created + INTERVAL 8 DAY END AS "cancelledAt",
  CASE WHEN prio IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'voluntary-fee'
       WHEN prio = '4-NOT SPECIFIED' THEN CASE WHEN k % 2 = 0 THEN 'ach' ELSE 'boost' END
       WHEN prio = '5-LOW' THEN CASE k % 5 WHEN 0 THEN 'stripe' WHEN 1 THEN 'stripecard'
            WHEN 2 THEN 'uesp' WHEN 3 THEN 'rollover-earnings' WHEN 4 THEN 'paper' END
  END AS type,
  st AS state,
  CASE WHEN (k // 2) % 5 IN (2, 3) THEN c END AS "bankAccountId",
  CASE WHEN (k // 2) % 5 IN (0, 1) THEN c END AS "creditCardId",
  CAST(k % 4 AS INTEGER) AS retries,
  CASE WHEN k % 2 = 0 THEN 'm0' ELSE 'm1' END AS "settlementMethod"
FROM (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS prio, o_totalprice,
         TIMESTAMP '2021-01-01 00:00:00'
           + to_days(CAST((o_orderkey * 7919) % 547 AS INTEGER))
           + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created,
         CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'initiated'
              WHEN 'P' THEN CASE o_orderkey % 6 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'failed'
                   WHEN 2 THEN 'refunded' WHEN 3 THEN 'returned' WHEN 4 THEN 'pending' END
         END AS st
  FROM orders
)
"""

ADAPTERS["src_users"] = """
SELECT
  k AS id,
  c_name AS uuid,
  CASE WHEN k % 97 = 0 THEN 'Support@x.example' WHEN k % 89 = 0 THEN NULL
       ELSE 'u' || CAST(k AS VARCHAR) || '@mail.example' END AS email,
  CASE WHEN k % 19 <> 0 THEN 'F' || CAST(k AS VARCHAR) END AS "firstName",
  CASE WHEN k % 23 <> 0 THEN 'L' || CAST(k AS VARCHAR) END AS "lastName",
  CAST(k AS VARCHAR) || ' Main St' AS "streetAddress",
  '94105' AS "zipCode", 'San Francisco' AS city, 'CA' AS state,
  CASE WHEN k % 31 <> 0 THEN DATE '1970-01-01' + CAST((k * 17) % 12000 AS INTEGER) END AS dob,
  CAST(NULL AS VARCHAR) AS photo,
  CASE k % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender,
  created AS "createdAt",
  created + INTERVAL 1 DAY AS "updatedAt",
  CASE WHEN k % 61 = 0 THEN created + INTERVAL 2 DAY END AS "deletedAt",
  CASE WHEN k % 83 <> 0 THEN k % 101 = 0 END AS admin,
  CASE WHEN k % 83 <> 0 THEN k % 103 = 0 END AS test,
  CASE WHEN k % 7 = 0 THEN 'inactive' WHEN k % 7 = 1 THEN NULL ELSE 'active' END AS status,
  CAST(NULL AS VARCHAR) AS "statusReason",
  'standard' AS pricing,
  k % 1000 AS "voluntaryFee",
  k % 50 = 0 AS "exemptFromFee",
  CASE WHEN k % 2 = 0 THEN k END AS "bankAccountID",
  CASE WHEN k % 2 = 1 THEN k END AS "creditCardID",
  CASE WHEN k % 2 = 1 THEN 'cus_' || CAST(k AS VARCHAR) END AS "ccStripeCustomerID",
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'foundation' WHEN c_mktsegment = 'FURNITURE' THEN NULL
       ELSE lower(c_mktsegment) END AS "utmSource",
  lower(c_mktsegment) AS "utmMedium",
  'spring' AS "utmCampaign",
  CASE WHEN k % 9 = 0 THEN k * 2 END AS "currentFundDraftId",
  'a' AS variant
FROM (SELECT *, c_custkey AS k,
             TIMESTAMP '2019-06-01 00:00:00' + to_days(CAST((c_custkey * 37) % 1100 AS INTEGER)) AS created
      FROM customer)
"""

ADAPTERS["src_funds"] = """
SELECT
  k * 2 AS id, seg AS uuid,
  '  Ann  ' || CAST(k AS VARCHAR) AS first,
  CASE WHEN k % 2 <> 0 THEN 'M' END AS middle,
  CASE WHEN k % 11 <> 0 THEN 'Lee' END AS last,
  CASE WHEN k % 29 <> 0 THEN DATE '2005-01-31' + CAST((k * 13) % 6000 AS INTEGER) END AS dob,
  seg AS photo, seg AS handle,
  CASE k % 9
    WHEN 0 THEN 'Hello! With Your Help we can save'
    WHEN 1 THEN 'BACKER is a smart way to save for college by inviting family and friends to contribute today'
    WHEN 2 THEN 'Ahoy There! A new saver'
    WHEN 3 THEN 'We hope to provide Sam with an opportunity to pursue the education of choice'
    WHEN 4 THEN 'Dear All, I would like to invite you to contribute to the fund'
    WHEN 5 THEN 'Hi! I am super excited to tell you about a new fund we set up for Max and college education'
    WHEN 6 THEN '  Custom TEXT  '
    WHEN 8 THEN ''
  END AS description,
  created AS "createdAt", created + INTERVAL 1 DAY AS "updatedAt",
  misc AS "deletedAt", misc AS "abandonedAt",
  created + INTERVAL 2 DAY AS "establishedAt", created + INTERVAL 3 DAY AS "fundedAt",
  misc AS "firstOneTimePaymentSettledAt", misc AS "firstRecurringPaymentSettledAt",
  misc AS "firstFamilyFundOn", misc AS "firstFamilyPaymentOn",
  CASE WHEN k % 3 = 0 THEN created + INTERVAL 4 DAY END AS "upgradeStartedAt",
  CASE WHEN k % 6 = 0 THEN created + INTERVAL 5 DAY END AS "upgradeEstablishedAt",
  seg AS "fundName", k AS owner,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 0
       WHEN k % 4 = 0 THEN bal * 8 WHEN k % 4 = 1 THEN bal // 10 ELSE bal END AS "collegeSavingsBalance",
  CASE WHEN k % 6 = 0 THEN 'inactive' WHEN k % 6 = 1 THEN NULL ELSE 'active' END AS status,
  CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' END AS "lpoaStatus",
  seg AS "statusReason",
  CASE WHEN k % 5 <> 0 THEN 'A' || CAST(k AS VARCHAR) END AS "accountNumber",
  k % 900 AS "feeBalance", seg AS pricing, seg AS gender, seg AS "coverUrl",
  CASE WHEN k % 43 <> 0 THEN (['b1', 'b2', 'b3'])[1:CAST(k % 4 AS INTEGER)] END AS backers,
  CASE WHEN k % 8 = 0 THEN k END AS "fromGift",
  seg AS "planId", seg AS plan,
  CASE k % 4 WHEN 0 THEN 'my529' WHEN 1 THEN 'safe' WHEN 2 THEN 'cyp' END AS "programManager",
  seg AS portfolio, seg AS "expectedDob", seg AS prebirth
FROM (SELECT c_custkey AS k, lower(c_mktsegment) AS seg,
             CAST(round(c_acctbal * 100) AS BIGINT) AS bal,
             TIMESTAMP '2020-05-01 00:00:00' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS created,
             CASE WHEN c_custkey % 10 = 0
                  THEN TIMESTAMP '2020-05-01 00:00:00' + to_days(CAST(c_custkey % 700 AS INTEGER)) + INTERVAL 6 DAY
             END AS misc
      FROM customer WHERE c_custkey % 7 <> 0)
UNION ALL
SELECT
  c_custkey * 2 + 1, NULL, 'Bo', NULL, 'a><b', DATE '2010-02-28',
  NULL, NULL, NULL,
  TIMESTAMP '2021-05-01 00:00:00', TIMESTAMP '2021-05-01 00:00:00', NULL, NULL,
  TIMESTAMP '2021-05-01 00:00:00', TIMESTAMP '2021-05-01 00:00:00', NULL, NULL, NULL, NULL,
  TIMESTAMP '2021-05-01 00:00:00', NULL,
  NULL, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT),
  'active', 'completed', NULL, 'B' || CAST(c_custkey AS VARCHAR),
  0, NULL, NULL, NULL, CAST([] AS VARCHAR[]), NULL, NULL, NULL, 'my529', NULL, NULL, NULL
FROM customer WHERE c_custkey % 5 = 0
"""

ADAPTERS["src_transactions"] = """
SELECT
  k * 10 + n AS id, k AS "paymentID",
  CASE WHEN n = 6 THEN 'ach-push-tip' WHEN n = 7 THEN 'ach-push-fee' ELSE 'ach-pull' END AS type,
  st AS state,
  created AS "createdAt",
  created + INTERVAL 1 DAY AS "updatedAt",
  created AS date,
  CASE WHEN st = 'settled' THEN created + INTERVAL 2 DAY END AS "settledAt"
FROM (
  SELECT k, n,
         CASE WHEN min_supp % 10 <= 5 THEN 'settled' WHEN min_supp % 10 = 6 THEN 'failed'
              WHEN min_supp % 10 = 7 THEN 'refunded' WHEN min_supp % 10 = 8 THEN 'initiated'
              WHEN min_supp % 10 = 9 THEN 'cancelled' END AS st,
         CASE WHEN k % 53 = 0 AND n = 2 THEN NULL ELSE first_ship END AS created
  FROM (SELECT l_orderkey AS k, l_linenumber AS n, min(l_suppkey) AS min_supp,
               min(l_shipdate) AS first_ship
        FROM lineitem GROUP BY l_orderkey, l_linenumber)
)
"""

ADAPTERS["src_attempts"] = """
SELECT
  l_orderkey, l_suppkey,
  l_orderkey * 1000 + l_linenumber * 100
    + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                         ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS id,
  l_orderkey * 10 + l_linenumber AS tx,
  l_shipdate AS "createdAt",
  CASE WHEN l_partkey % 9 = 0 THEN 'E' || CAST(l_partkey % 5 AS VARCHAR) END AS code,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount
FROM lineitem
"""

ADAPTERS["src_stripe_transactions"] = """
SELECT "createdAt", tx AS "transactionId", id, code AS "declineCode", amount
FROM src_attempts WHERE l_orderkey % 2 = 1
"""

ADAPTERS["src_ach_transactions"] = """
SELECT "createdAt", tx AS "transactionID", id, code AS "returnCode",
       'R' || CAST(l_suppkey AS VARCHAR) AS "routingNumber", amount,
       'F' || CAST(l_orderkey % 100 AS VARCHAR) AS "achFileID"
FROM src_attempts WHERE l_orderkey % 2 = 0
"""

_CONTRIBUTOR_COLUMNS = """
  TIMESTAMP '2021-01-01 00:00:00' + to_days(CAST(k % 300 AS INTEGER)) AS "createdAt",
  TIMESTAMP '2021-01-01 00:00:00' + to_days(CAST(k % 300 AS INTEGER)) + INTERVAL 1 DAY AS "updatedAt",
  CASE WHEN k % 10 = 0 THEN TIMESTAMP '2021-01-01 00:00:00' + to_days(CAST(k % 300 AS INTEGER))
       + INTERVAL 2 DAY END AS "deletedAt",
  CASE WHEN k % 3 = 1 THEN 'friend' ELSE 'owner' END AS type,
  CASE WHEN k % 3 = 1 THEN 'family' ELSE 'self' END AS relationship,
  "fundID"
"""

ADAPTERS["src_contributors"] = f"""
SELECT k AS id, "userID", {_CONTRIBUTOR_COLUMNS}
FROM (SELECT o_custkey AS "userID", o_custkey * 2 + (o_orderkey // 3) % 2 AS "fundID",
             min(o_orderkey) AS k
      FROM orders GROUP BY 1, 2)
UNION ALL
SELECT -k - 1 AS id, "userID", {_CONTRIBUTOR_COLUMNS}
FROM (SELECT o_custkey AS "userID", o_custkey * 2 + (o_orderkey // 3) % 2 AS "fundID",
             min(o_orderkey) AS k
      FROM orders GROUP BY 1, 2)
WHERE k % 19 = 0
"""

ADAPTERS["src_contributions"] = """
SELECT
  created AS "createdAt", created + INTERVAL 1 DAY AS "updatedAt",
  CASE WHEN k % 10 = 0 THEN created + INTERVAL 2 DAY END AS "deletedAt",
  k AS id, CASE WHEN k % 8 = 0 THEN k - 2 END AS "originalContributionId",
  CASE (k // 2) % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'edited'
       WHEN 3 THEN 'invalid' WHEN 4 THEN 'paused' END AS state,
  freq AS frequency,
  'v' || CAST(k % 3 AS VARCHAR) AS variant,
  k % 5 = 0 AS "createdAsStarterGift",
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
  k % 100 AS tip, k % 50 AS "processingFee",
  CASE WHEN k % 4 = 0 THEN c END AS "bankAccountID",
  CASE WHEN k % 4 = 2 THEN c END AS "creditCardID",
  CASE WHEN freq = 'monthly' THEN 'sub_' || CAST(k AS VARCHAR) END AS "stripeSubscriptionID",
  CASE WHEN k % 6 = 0 THEN 'Kid' END AS "recipientName",
  CASE WHEN k % 6 = 0 THEN 'Parent' END AS "recipientParentName",
  CASE WHEN k % 6 = 0 THEN 'Enjoy' END AS "recipientMessage",
  CASE WHEN k % 6 = 0 THEN 'p@mail.example' END AS "recipientEmailAddress",
  c AS "userID", c * 2 + (k // 3) % 2 AS "collegeFundID"
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice,
             TIMESTAMP '2021-01-01 00:00:00' + to_days(CAST(o_orderkey % 500 AS INTEGER)) AS created,
             CASE (o_orderkey // 12) % 3 WHEN 0 THEN 'onetime' WHEN 1 THEN 'monthly' END AS freq
      FROM orders WHERE o_orderkey % 2 = 0)
"""

ADAPTERS["src_affiliate_links"] = """
SELECT s_suppkey AS id, s_suppkey AS "userId",
       TIMESTAMP '2021-03-01 00:00:00' + to_days(CAST(s_suppkey % 400 AS INTEGER)) AS "createdAt"
FROM supplier
"""

ADAPTERS["src_affiliate_commissions"] = """
SELECT p_partkey // 25 AS "affiliateLinkId", p_partkey AS "fundVoucherId", p_type AS state,
       CAST(round(p_retailprice * 100) AS BIGINT) AS payout,
       CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS description,
       CASE WHEN p_partkey % 10 = 0 THEN 1 WHEN p_partkey % 10 = 1 THEN NULL
            ELSE p_partkey % 1000 END AS "userId"
FROM part
"""
