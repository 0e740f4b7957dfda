"""DuckDB SQL for the cleaned relations (CTE bodies over the ``src_*``
adapters). 'PST' is the fixed UTC-08:00 offset, written as interval
arithmetic; the reporting instant replaces NOW().
"""

from __future__ import annotations

AS_OF = "2022-06-20 12:00:00"


def pst(col: str) -> str:
    return f"({col} - INTERVAL 8 HOUR)"


def day_pst(col: str) -> str:
    return f"(CAST(CAST({col} AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR)"


def cents(col: str) -> str:
    return f"(CAST({col} AS BIGINT) * 0.01)"


def age_years(dob: str) -> str:
    return f"date_part('year', age(TIMESTAMP '{AS_OF}', CAST({dob} AS TIMESTAMP)))"


def age_months(dob: str) -> str:
    return f"date_part('month', age(TIMESTAMP '{AS_OF}', CAST({dob} AS TIMESTAMP)))"


def blanks(expr: str) -> str:
    return f"trim(replace(replace(replace({expr}, ' ', '<>'), '><', ''), '<>', ' '))"


# Source and output names of timestamps.
_ACH_TIMES = [("initiatedAt", "payment_initiated_at"), ("pullSettledAt", "payment_pull_settled_at"),
              ("pushedAt", "payment_pushed_at"), ("pushSettledAt", "payment_push_settled_at"),
              ("settledAt", "payment_settled_at"), ("refundedAt", "payment_refunded_at"),
              ("cancelRequestedAt", "payment_cancel_requested_at"),
              ("cancelledAt", "payment_cancelled_at")]

# The value lists and patterns below are fixed values.
CLEAN: dict[str, str] = {}

CLEAN["p_clean"] = f"""
SELECT
  id AS payment_id, "ownerId" AS user_id, "fundID" AS fund_id,
  "contributionID" AS contribution_id, "migratedWithPayment" AS payment_migrated_with_payment,
  coalesce({cents('amount')}, 0) AS payment_amount_usd,
  coalesce({cents('"processingFee"')}, 0) AS payment_processing_fee_usd,
  coalesce({cents('"subscriptionFee"')}, 0) AS payment_subscription_fee_usd,
  coalesce({cents('tip')}, 0) AS payment_tip_usd,
  {pst('"createdAt"')} AS payment_created_at,
  {day_pst('"transactionDate"')} AS payment_transaction_date,
  {day_pst('"dueDate"')} AS payment_due_date,
  {pst('"updatedAt"')} AS payment_updated_at,
  {pst('"deletedAt"')} AS payment_deleted_at,
  "createdAt" AS payment_created_at_utc,
  CAST("transactionDate" AS DATE) AS payment_transaction_date_utc,
  CAST("dueDate" AS DATE) AS payment_due_date_utc,
  "updatedAt" AS payment_updated_at_utc,
  "deletedAt" AS payment_deleted_at_utc,
  {", ".join(f'{pst(chr(34) + s + chr(34))} AS {d}' for s, d in _ACH_TIMES)},
  {", ".join(f'"{s}" AS {d}_utc' for s, d in _ACH_TIMES)},
  type AS payment_type,
  "bankAccountId" AS payment_bank_account_id,
  "creditCardId" AS payment_credit_card_id,
  CASE WHEN type IN ('authorize-net', 'uesp') THEN 'Legacy'
       WHEN type IN ('migration-to-my529', 'scholarshare', 'voluntary-fee', 'rollover-earnings',
                     'rollover-contribution') THEN 'Operational'
       WHEN type LIKE 'ach%' THEN 'ACH'
       WHEN type IN ('stripe', 'stripecard') THEN 'Credit Card' END AS payment_method_type,
  CASE WHEN type = 'voluntary-fee' THEN 'Subscription Fee'
       WHEN "contributionID" IS NOT NULL THEN 'Contribution Payment'
       ELSE 'Unknown' END AS payment_is_for,
  retries AS payment_retries,
  "settlementMethod" AS payment_settlement_method,
  state AS payment_state
FROM src_payments
"""

# Source and output names of timestamps.
_FUND_TIMES = [("createdAt", "fund_created_at"), ("updatedAt", "fund_updated_at"),
               ("deletedAt", "fund_deleted_at"), ("abandonedAt", "fund_abandoned_at"),
               ("establishedAt", "fund_established_at"), ("fundedAt", "fund_funded_at"),
               ("firstOneTimePaymentSettledAt", "first_fund_onetime_payment_settled_at"),
               ("firstRecurringPaymentSettledAt", "first_fund_recurring_payment_settled_at"),
               ("firstFamilyFundOn", "first_family_fund_on"),
               ("firstFamilyPaymentOn", "first_family_payment_on"),
               ("upgradeStartedAt", "my529_upgrade_started_at"),
               ("upgradeEstablishedAt", "my529_upgrade_established_at")]

# Lower bounds (USD) and labels of the balance bands.
_BAND_BOUNDS = "[100, 500, 1000, 5000, 10000, 15000, 50000]"
_BAND_LABELS = ("['01: $1-$99', '02: $100-$499', '03: $500-$999', '04: $1,000-$4,999', '05: $5,000-$9,999', "
                "'06: $10,000-$14,999', '07: $15,000-$49,999', '08: $50,000+']")
_BAL = cents('"collegeSavingsBalance"')

CLEAN["f_clean"] = f"""
SELECT
  id AS fund_id, uuid AS fund_uuid,
  first AS beneficiary_first_name, middle AS beneficiary_middle_name, last AS beneficiary_last_name,
  {blanks("coalesce(first, '') || ' ' || coalesce(last, '')")} AS beneficiary_full_name,
  {blanks("coalesce(first, '') || ' ' || coalesce(middle, '') || ' ' || coalesce(last, '')")}
    AS beneficiary_full_name_middle,
  dob AS beneficiary_dob,
  {age_years('dob')} AS beneficiary_age_years,
  {age_months('dob')} AS beneficiary_age_months,
  photo AS fund_photo, handle AS fund_handle,
  CASE
    WHEN description ILIKE '%with your help%' THEN 'with your help...'
    WHEN description ILIKE '%backer is a smart way to save for college by inviting family and friends to contribute%'
      THEN 'backer is a smart way...'
    WHEN description ILIKE '%ahoy there!%' THEN 'ahoy there...'
    WHEN description ILIKE '%we hope to provide%with an opportunity to pursue the education%'
      THEN 'we hope to provide...'
    WHEN description ILIKE '%dear all%i%d like to invite you to contribute to %' THEN 'dear all...'
    WHEN description ILIKE '%i%m super excited to tell you about a new fund we set up for%college education%'
      THEN 'hi friend...'
    ELSE trim(lower(description)) END AS fund_description,
  {", ".join(f'{pst(chr(34) + s + chr(34))} AS {d}' for s, d in _FUND_TIMES)},
  "upgradeStartedAt" IS NOT NULL AS my529_upgrade_started_at_set,
  "upgradeEstablishedAt" IS NOT NULL AS my529_upgrade_established_at_set,
  "fundName" AS fund_name, owner AS fund_owner_user_id,
  {_BAL} AS fund_balance_usd,
  CASE WHEN coalesce("collegeSavingsBalance", 0) = 0 THEN '00: $0'
       ELSE {_BAND_LABELS}[1 + len(list_filter({_BAND_BOUNDS}, lambda b: b <= {_BAL}))] END AS fund_balance_group,
  status AS fund_status, "lpoaStatus" AS fund_lpoa_status, "statusReason" AS fund_status_reason,
  "accountNumber" AS fund_account_number,
  {cents('"feeBalance"')} AS fee_balance_usd,
  pricing AS fund_pricing, gender AS fund_gender,
  status <> 'inactive' AS fund_is_active,
  "coverUrl" AS fund_cover_photo,
  CAST(to_json(backers) AS VARCHAR) AS fund_backers,
  json_array_length(to_json(backers)) AS num_fund_backers,
  "fromGift" IS NOT NULL AS fund_is_from_gift,
  "fromGift" AS from_gift_id,
  "planId" AS fund_plan_id, plan AS fund_plan_type, "programManager" AS fund_plan_manager,
  portfolio AS fund_plan_investment_portfolio,
  "expectedDob" AS fund_expected_dob, prebirth AS fund_prebirth_status
FROM src_funds
"""

CLEAN["u_clean"] = f"""
SELECT
  id AS user_id, uuid AS user_uuid, email AS user_email,
  coalesce("firstName", '') || ' ' || coalesce("lastName", '') AS user_full_name,
  "firstName" AS user_first_name, "lastName" AS user_last_name,
  "streetAddress" AS user_street_address, "zipCode" AS user_zip_code,
  city AS user_city, state AS user_state, dob AS user_dob, photo AS user_photo,
  {age_years('dob')} AS user_age_years,
  {age_months('dob')} AS user_age_months,
  gender AS user_gender,
  {pst('"createdAt"')} AS user_created_at,
  {pst('"updatedAt"')} AS user_updated_at,
  {pst('"deletedAt"')} AS user_deleted_at,
  (admin OR id IN (57193, 545, 45080, 40000, 2000000) OR email ILIKE '%support@%'
     OR email ILIKE '%backer.com%' OR test) AS user_is_admin,
  status AS user_status, "statusReason" AS user_status_reason,
  (status = 'active' OR status IS NULL) AS user_is_active,
  pricing AS user_pricing,
  {cents('"voluntaryFee"')} AS user_voluntary_fee_usd,
  "exemptFromFee" AS user_exempt_from_fee,
  "bankAccountID" AS user_bank_account_id, "creditCardID" AS user_credit_card_id,
  "ccStripeCustomerID" AS user_cc_stripe_customer_id,
  coalesce("utmSource" = 'foundation', false) AS user_from_foundation,
  "utmSource" AS user_utm_source, "utmMedium" AS user_utm_medium, "utmCampaign" AS user_utm_campaign,
  CASE WHEN {pst('"createdAt"')} < TIMESTAMP '2020-07-01' THEN 'legacy'
       WHEN {pst('"createdAt"')} < TIMESTAMP '2021-11-24' THEN 'subscription'
       ELSE 'backer2' END AS user_era,
  "currentFundDraftId" AS user_current_fund_draft_id, variant AS user_variant
FROM src_users
"""

CLEAN["contrib_clean"] = f"""
SELECT
  c.id AS contributor_id, c."userID" AS contributor_user_id,
  {pst('c."createdAt"')} AS contributor_created_at,
  {pst('c."updatedAt"')} AS contributor_updated_at,
  {pst('c."deletedAt"')} AS contributor_deleted_at,
  c.type AS contributor_type, c.relationship AS contributor_relationship,
  {pst('x."createdAt"')} AS contribution_created_at,
  {pst('x."updatedAt"')} AS contribution_updated_at,
  {pst('x."deletedAt"')} AS contribution_deleted_at,
  c."fundID" AS fund_id,
  x.id AS contribution_id, x."originalContributionId" AS contribution_original_id,
  x.state AS contribution_state, x.frequency AS contribution_frequency,
  x.variant AS contribution_variant,
  x."createdAsStarterGift" AS contribution_created_at_starter_gift,
  x.state NOT IN ('cancelled', 'invalid', 'edited') AS contribution_is_active,
  x.frequency <> 'onetime' AS contribution_is_recurring,
  {cents('x.amount')} AS contribution_amount_usd,
  {cents('x.tip')} AS contribution_tip_usd,
  {cents('x."processingFee"')} AS contribution_processing_fee_usd,
  x."bankAccountID" AS contribution_bank_account_id,
  x."creditCardID" AS contribution_credit_card_id,
  x."stripeSubscriptionID" AS contribution_stripe_subscription_id,
  x."recipientName" AS contribution_recipient_name,
  x."recipientParentName" AS contribution_recipient_parent_name,
  x."recipientMessage" AS contribution_recipient_message,
  x."recipientEmailAddress" AS contribution_recipient_email
FROM src_contributors c
LEFT JOIN src_contributions x ON c."userID" = x."userID" AND c."fundID" = x."collegeFundID"
"""

CLEAN["tx_clean"] = f"""
SELECT id AS transaction_id, "paymentID" AS payment_id, type AS transaction_type_detail,
       state AS transaction_state,
       {pst('"createdAt"')} AS transaction_created_at,
       {pst('"updatedAt"')} AS transaction_updated_at,
       {day_pst('date')} AS transaction_date,
       {pst('"settledAt"')} AS transaction_settled_at
FROM src_transactions
"""

CLEAN["attempts_clean"] = f"""
SELECT 'Credit Card Transaction' AS transaction_type,
       {pst('"createdAt"')} AS cc_or_ach_created_at,
       "transactionId" AS transaction_id, id AS cc_or_ach_transaction_id,
       "declineCode" AS cc_or_ach_error_code,
       {cents('amount')} AS transaction_amount_usd,
       CAST(NULL AS VARCHAR) AS ach_file_id, CAST(NULL AS VARCHAR) AS ach_transaction_routing_number,
       "declineCode" IS NULL AS cc_or_ach_transaction_succeeded
FROM src_stripe_transactions
UNION ALL
SELECT 'ACH Transaction', {pst('"createdAt"')}, "transactionID", id, "returnCode",
       {cents('amount')}, "achFileID", "routingNumber", "returnCode" IS NULL
FROM src_ach_transactions
"""
