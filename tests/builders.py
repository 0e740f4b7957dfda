"""Small in-memory source tables for literal test cases. Missing columns are
NULL; the schemas are those the fixture adapters produce."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

PAYMENTS = """id bigint, ownerId bigint, fundID bigint, contributionID bigint,
migratedWithPayment bigint, amount bigint, tip bigint, processingFee bigint, subscriptionFee bigint,
createdAt timestamp_ntz, transactionDate timestamp_ntz, dueDate timestamp_ntz, updatedAt timestamp_ntz,
deletedAt timestamp_ntz, initiatedAt timestamp_ntz, pullSettledAt timestamp_ntz, pushedAt timestamp_ntz,
pushSettledAt timestamp_ntz, settledAt timestamp_ntz, refundedAt timestamp_ntz,
cancelRequestedAt timestamp_ntz, cancelledAt timestamp_ntz, type string, state string,
bankAccountId bigint, creditCardId bigint, retries int, settlementMethod string"""

USERS = """id bigint, uuid string, email string, firstName string, lastName string,
streetAddress string, zipCode string, city string, state string, dob date, photo string,
passwordHash string, gender string, createdAt timestamp_ntz, updatedAt timestamp_ntz,
deletedAt timestamp_ntz, admin boolean, test boolean, status string, statusReason string,
pricing string, voluntaryFee bigint, exemptFromFee boolean, bankAccountID bigint, creditCardID bigint,
ccStripeCustomerID string, utmSource string, utmMedium string, utmCampaign string,
currentFundDraftId bigint, variant string"""

FUNDS = """id bigint, uuid string, first string, middle string, last string, dob date, photo string,
handle string, description string, createdAt timestamp_ntz, updatedAt timestamp_ntz,
deletedAt timestamp_ntz, abandonedAt timestamp_ntz, establishedAt timestamp_ntz,
fundedAt timestamp_ntz, firstOneTimePaymentSettledAt timestamp_ntz,
firstRecurringPaymentSettledAt timestamp_ntz, firstFamilyFundOn timestamp_ntz,
firstFamilyPaymentOn timestamp_ntz, upgradeStartedAt timestamp_ntz, upgradeEstablishedAt timestamp_ntz,
fundName string, owner bigint, collegeSavingsBalance bigint, status string, lpoaStatus string,
statusReason string, accountNumber string, feeBalance bigint, pricing string, gender string,
coverUrl string, backers array<string>, fromGift bigint, planId string, plan string,
programManager string, portfolio string, expectedDob string, prebirth string"""

TRANSACTIONS = """id bigint, paymentID bigint, type string, state string, createdAt timestamp_ntz,
updatedAt timestamp_ntz, date timestamp_ntz, settledAt timestamp_ntz"""

STRIPE = "createdAt timestamp_ntz, transactionId bigint, id bigint, declineCode string, amount bigint"

ACH = """createdAt timestamp_ntz, transactionID bigint, id bigint, returnCode string,
routingNumber string, amount bigint, achFileID string"""


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def d(text: str) -> date:
    return date.fromisoformat(text)


def table(spark: SparkSession, ddl: str, rows: list[dict]) -> DataFrame:
    names = [part.strip().split()[0] for part in ddl.replace("\n", " ").split(",")]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, schema=ddl.replace("\n", " "))
