"""Benchmark of the headline queries.

Reads the driver's tables at $BENCH_SF_DIR (default /root/testdata/sf0.1),
derives the ten source tables once and writes them as parquet to a fresh
scratch folder (the form a deployment reads), then times each headline query
over those files: one warm-up run, then the median of $BENCH_RUNS runs
(default 5), each forced with the ``noop`` writer. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from ledgerlens import DEFAULT_AS_OF  # noqa: E402
from ledgerlens.operators import churn, revenue  # noqa: E402
from ledgerlens.plans import reports  # noqa: E402
from ledgerlens.plans.catalog import Workspace, report  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.sources import SOURCE_TABLES, Sources, fixture_sources, read_sources  # noqa: E402
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def newest_by_window_values(transactions_clean):
    """The newest transaction by five FIRST_VALUEs and a DISTINCT, for comparison."""
    cols = ("transaction_id", "transaction_created_at", "transaction_state",
            "transaction_type_detail", "transaction_settled_at")
    w = Window.partitionBy("payment_id").orderBy(
        F.col("transaction_created_at").desc_nulls_first(), F.col("transaction_id").desc())
    rows = transactions_clean.where(~F.col("transaction_type_detail").isin(*churn.SIDE_TRANSACTION_TYPES))
    return rows.select("payment_id", *[F.first(c).over(w).alias(c) for c in cols]).distinct()


def next_payment_by_plain_window(fee_payments):
    """The next payment by one window per user, for comparison."""
    w = Window.partitionBy("user_id").orderBy(
        F.col("payment_created_at_month").asc_nulls_last(), "payment_id",
        F.col("cc_or_ach_transaction_id").asc_nulls_last())
    return fee_payments.select("*", *[F.lead(v).over(w).alias(o) for o, v in churn._NEXT_VALUES.items()])


def headline(src: Sources) -> dict:
    ws = Workspace(None, sources=src)
    return {
        "cohort_retention": lambda: reports.cohort_retention_report(src, DEFAULT_AS_OF),
        "churn_status": lambda: reports.churn_report(src, DEFAULT_AS_OF),
        "paying_users": lambda: reports.paying_users_report(src),
        "conversion_funnel": lambda: reports.conversion_funnel_report(src, DEFAULT_AS_OF),
        "latest_transaction_per_payment": lambda: ws.latest_transactions,
        "latest_transaction_per_payment__first_values": lambda: newest_by_window_values(ws.transactions),
        "fee_next_payment": lambda: churn.fee_next_payment(
            ws.fee_payments, hot=churn.hot_payers(ws.payments, ws.fee_payments, churn.hot_transactions(ws.card_ach))),
        "fee_next_payment__plain_window": lambda: next_payment_by_plain_window(ws.fee_payments),
        "revenue_from_payments": lambda: revenue.revenue_from_payments(src.payments),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    scratch = tempfile.mkdtemp(prefix="ledgerlens-bench-")
    spark = build_session(f"local[{cpus}]", app_name="ledgerlens-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus))),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
                                 "spark.local.dir": scratch})

    t0 = time.perf_counter()
    derived = fixture_sources(spark, sf_dir)
    for name in SOURCE_TABLES:
        getattr(derived, name).write.mode("overwrite").parquet(f"{scratch}/sources/{name}")
    materialize = time.perf_counter() - t0

    timings = {}
    for name, build in headline(read_sources(spark, f"{scratch}/sources")).items():
        if only and name not in only:
            continue
        samples = []
        for i in range(runs + 1):
            t = time.perf_counter()
            report(build()).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t)
        timings[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    core = ["cohort_retention", "churn_status", "paying_users", "conversion_funnel"]
    print(json.dumps({
        "metric": "sum_of_median_sec_core_queries",
        "value": round(sum(timings.get(q, 0.0) for q in core), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
        "materialize_sources_sec": round(materialize, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
