"""Declared schemas of the ten source tables.

Fixed values: column names and types as the warehouse stores them. Timestamps
are wall-clock times in UTC. ``backers`` may also be stored as JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COLUMNS = {
    "payments": (
        "id bigint, ownerId bigint, fundID bigint, contributionID bigint, migratedWithPayment bigint, "
        "amount bigint, tip bigint, processingFee bigint, subscriptionFee bigint, "
        "createdAt timestamp_ntz, transactionDate timestamp_ntz, dueDate timestamp_ntz, "
        "updatedAt timestamp_ntz, deletedAt timestamp_ntz, initiatedAt timestamp_ntz, "
        "pullSettledAt timestamp_ntz, pushedAt timestamp_ntz, pushSettledAt timestamp_ntz, "
        "settledAt timestamp_ntz, refundedAt timestamp_ntz, cancelRequestedAt timestamp_ntz, "
        "cancelledAt timestamp_ntz, type string, state string, bankAccountId bigint, "
        "creditCardId bigint, retries int, settlementMethod string"),
    "users": (
        "id bigint, uuid string, email string, firstName string, lastName string, "
        "streetAddress string, zipCode string, city string, state string, dob date, photo string, "
        "gender string, createdAt timestamp_ntz, updatedAt timestamp_ntz, deletedAt timestamp_ntz, "
        "admin boolean, test boolean, status string, statusReason string, pricing string, "
        "voluntaryFee bigint, exemptFromFee boolean, bankAccountID bigint, creditCardID bigint, "
        "ccStripeCustomerID string, utmSource string, utmMedium string, utmCampaign string, "
        "currentFundDraftId bigint, variant string"),
    "funds": (
        "id bigint, uuid string, first string, middle string, last string, dob date, photo string, "
        "handle string, description string, createdAt timestamp_ntz, updatedAt timestamp_ntz, "
        "deletedAt timestamp_ntz, abandonedAt timestamp_ntz, establishedAt timestamp_ntz, "
        "fundedAt timestamp_ntz, firstOneTimePaymentSettledAt timestamp_ntz, "
        "firstRecurringPaymentSettledAt timestamp_ntz, firstFamilyFundOn timestamp_ntz, "
        "firstFamilyPaymentOn timestamp_ntz, upgradeStartedAt timestamp_ntz, "
        "upgradeEstablishedAt timestamp_ntz, fundName string, owner bigint, "
        "collegeSavingsBalance bigint, status string, lpoaStatus string, statusReason string, "
        "accountNumber string, feeBalance bigint, pricing string, gender string, coverUrl string, "
        "backers array<string>, fromGift bigint, planId string, plan string, programManager string, "
        "portfolio string, expectedDob string, prebirth string"),
    "contributors": (
        "id bigint, userID bigint, createdAt timestamp_ntz, updatedAt timestamp_ntz, "
        "deletedAt timestamp_ntz, type string, relationship string, fundID bigint"),
    "contributions": (
        "createdAt timestamp_ntz, updatedAt timestamp_ntz, deletedAt timestamp_ntz, id bigint, "
        "originalContributionId bigint, state string, frequency string, variant string, "
        "createdAsStarterGift boolean, amount bigint, tip bigint, processingFee bigint, "
        "bankAccountID bigint, creditCardID bigint, stripeSubscriptionID string, "
        "recipientName string, recipientParentName string, recipientMessage string, "
        "recipientEmailAddress string, userID bigint, collegeFundID bigint"),
    "transactions": (
        "id bigint, paymentID bigint, type string, state string, createdAt timestamp_ntz, "
        "updatedAt timestamp_ntz, date timestamp_ntz, settledAt timestamp_ntz"),
    "stripe_transactions": (
        "createdAt timestamp_ntz, transactionId bigint, id bigint, declineCode string, amount bigint"),
    "ach_transactions": (
        "createdAt timestamp_ntz, transactionID bigint, id bigint, returnCode string, "
        "routingNumber string, amount bigint, achFileID string"),
    "affiliate_links": "id bigint, userId bigint, createdAt timestamp_ntz",
    "affiliate_commissions": (
        "affiliateLinkId bigint, fundVoucherId bigint, state string, payout bigint, "
        "description string, userId bigint"),
}

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(),
          "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType())}

SCHEMAS: dict[str, T.StructType] = {
    table: T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    for table, columns in _COLUMNS.items()}


def declared(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of table ``name`` with their declared types.

    Zone-aware timestamps become wall-clock times of the session zone, which
    the library keeps at UTC. Columns beyond the declared ones are left behind;
    a missing one raises.
    """
    stored = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in SCHEMAS[name].fields if f.name not in stored]
    if missing:
        raise ValueError(f"table {name} lacks the columns {', '.join(missing)}")
    columns = []
    for field in SCHEMAS[name].fields:
        c = F.col(f"`{field.name}`")
        text_array = isinstance(field.dataType, T.ArrayType) and isinstance(stored[field.name], T.StringType)
        columns.append(c if text_array or stored[field.name] == field.dataType else c.cast(field.dataType).alias(field.name))
    return df.select(*columns)
