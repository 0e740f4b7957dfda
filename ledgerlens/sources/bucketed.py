"""The source tables as bucketed tables.

``write_bucketed`` stores each table hashed into the same number of buckets by
the key that its main join uses, sorted by it; ``read_bucketed`` gives them as
:class:`ledgerlens.sources.Sources`. Payments and transactions are bucketed by
payment, so the newest transaction of a payment (A9) and its join to the payment
(A10, A15) read matching buckets and exchange nothing; users, funds and
affiliate links are bucketed by their own id, the card and ACH attempts by
transaction, contributors and contributions by user, so that at most the other
side of such a join is exchanged.

The buckets of one payment key are alike in size unless a single payment holds
very many transactions; the partial top-1 of A9 runs before anything is
gathered, inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerlens.sources import SOURCE_TABLES, Sources
from ledgerlens.sources.schemas import declared

#: The column that each table is bucketed by.
BUCKET_KEYS = {
    "payments": "id", "transactions": "paymentID", "users": "id", "funds": "id", "contributors": "userID", "contributions": "userID",
    "stripe_transactions": "transactionId", "ach_transactions": "transactionID", "affiliate_links": "id", "affiliate_commissions": "affiliateLinkId",
}


def write_bucketed(sources: Sources, prefix: str, buckets: int, mode: str = "errorifexists") -> None:
    """Store all tables as ``<prefix><table>`` in the session's catalog.

    Choose ``buckets`` so that a bucket of the largest table is some hundred MB,
    and the same for all tables. Rows are dealt to one writer a bucket, so each
    bucket is one file.
    """
    for name in SOURCE_TABLES:
        key = BUCKET_KEYS[name]
        declared(getattr(sources, name), name).repartition(buckets, key).write.mode(mode) \
            .bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{prefix}{name}")


def read_bucketed(spark: SparkSession, prefix: str) -> Sources:
    """The tables that :func:`write_bucketed` stored under ``prefix``."""
    return Sources(lambda name: declared(spark.table(f"{prefix}{name}"), name))
