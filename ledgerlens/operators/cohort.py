"""Monthly cohort retention.

Every active month is its own cohort: a user active in January and March is
counted in the January cohort at offsets 0 and 2 and in the March cohort at
offset 0.

The source pairs every active month of a user with each later one through a
self-join. Here the same pairs come from one aggregate instead:

* Only months from the window start to the reporting month can be active, so
  a user's active months fit in ``ceil(M / 62)`` bigint bit masks, M being the
  number of months in the window (18 for the tested reporting date). Each mask
  is a ``bit_or`` aggregate per user: it has a map-side partial, so a user with
  a third of all payments leaves every map task as one row, and the state per
  user is a few longs whatever the data size.
* Pairs (active month, later active month) are generated per user from the
  masks inside the task that holds the user and are counted right away by a
  partial aggregate keyed by (month, offset); at most M*(M+1)/2 pairs per user.
  There is no join, so no sort, no second scan and no exchange keyed by user
  alone.
* Because each (user, month, offset) occurs once, the per-cohort
  ``COUNT(DISTINCT user)`` of the source is a plain count.
* Payments without an owner form one NULL group. They never match in the
  source's join, so they only add the row (month, NULL offset, 0 users) for
  each month in which they occur; the same pass emits it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import as_of_lit, month_start, to_pst
from ledgerlens.functions.timefn import PST_OFFSET_HOURS

# Fixed value: first month (PST) of the activity window.
ACTIVITY_START = "2021-01-01 00:00:00"
# Payment states that count as activity.
ACTIVE_PAYMENT_STATES = ("settled", "initiated")
# Months per bigint mask word (the sign bit is left unused).
MASK_BITS = 62


def _active_payments(payments_clean: DataFrame, as_of: str, start: str,
                     states: Sequence[str]) -> DataFrame:
    upper_pst = month_start(to_pst(as_of_lit(as_of)))
    shift = F.make_dt_interval(hours=F.lit(PST_OFFSET_HOURS))
    # The PST bounds are moved onto the stored UTC column (a constant shift),
    # so the range reaches the parquet scan as a pushed filter.
    in_window = F.col("payment_created_at_utc").between(
        F.lit(start).cast("timestamp_ntz") + shift, upper_pst + shift)
    return payments_clean.where(F.col("contribution_id").isNotNull()
                                & F.col("payment_state").isin(*states)
                                & in_window)


def monthly_activity(payments_clean: DataFrame, as_of: str, start: str = ACTIVITY_START,
                     states: Sequence[str] = ACTIVE_PAYMENT_STATES) -> DataFrame:
    """Distinct (user_id, PST month) of contribution payments that are
    settled or initiated, created (PST) between ``start`` and the start of
    the PST month of ``as_of``, both ends included."""
    return (_active_payments(payments_clean, as_of, start, states)
            .select("user_id", month_start("payment_created_at").alias("payment_created_at"))
            .distinct())


def window_months(as_of: str, start: str = ACTIVITY_START) -> int:
    """Number of calendar months a payment can fall in (a parameter bound,
    not a data statistic)."""
    upper = datetime.fromisoformat(as_of) - timedelta(hours=PST_OFFSET_HOURS)
    first = datetime.fromisoformat(start)
    return max(0, upper.year * 12 + upper.month - (first.year * 12 + first.month) + 1)


class _Masks:
    def __init__(self, payments_clean: DataFrame, as_of: str, start: str, states: Sequence[str], stored: DataFrame | None = None):
        self.months = window_months(as_of, start)
        self.words = max(1, math.ceil(self.months / MASK_BITS))
        self.cols = [f"mask{w}" for w in range(self.words)]
        first = datetime.fromisoformat(start)
        self.first_month = F.lit(f"{first.year:04d}-{first.month:02d}-01").cast("date")
        created = F.col("payment_created_at")
        idx = ((F.year(created) - first.year) * 12 + F.month(created) - first.month).cast("int")
        if stored is not None:
            known = [c for c in self.cols if c in stored.columns]
            self.df = stored.select("user_id", *[F.col(c) if c in known else F.lit(0).cast("bigint").alias(c) for c in self.cols])
            return
        aggs = []
        for w, name in enumerate(self.cols):
            lo, hi = w * MASK_BITS, (w + 1) * MASK_BITS
            bit = F.expr(f"CASE WHEN month_idx >= {lo} AND month_idx < {hi} "
                         f"THEN shiftleft(CAST(1 AS BIGINT), month_idx - {lo}) END")
            aggs.append(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")).alias(name))
        self.df = (_active_payments(payments_clean, as_of, start, states)
                   .select("user_id", idx.alias("month_idx"))
                   .groupBy("user_id").agg(*aggs))

    def bit_set(self, idx: str) -> Column:
        arms = " ".join(f"WHEN {idx} < {(w + 1) * MASK_BITS} "
                        f"THEN shiftright({name}, {idx} - {w * MASK_BITS})"
                        for w, name in enumerate(self.cols))
        return F.expr(f"(CASE {arms} END & 1) = 1")

    def month(self, idx: str) -> Column:
        return F.add_months(self.first_month, F.col(idx)).cast("timestamp_ntz")

    def pairs(self) -> DataFrame:
        """(user_id, a, r): every active month ``a`` of a user with each of the
        user's active months ``r >= a``. The ownerless group keeps one row per
        active month with ``r`` NULL, which is the row the source's outer
        self-join produces for it; everything comes from one pass."""
        last = F.lit(max(self.months, 1) - 1)
        starts = (self.df.select("user_id", *self.cols,
                                 F.explode(F.sequence(F.lit(0), last)).alias("a"))
                  .where(self.bit_set("a")))
        later = F.when(F.col("user_id").isNotNull(), F.sequence(F.col("a"), last))
        return (starts.select("user_id", "a", *self.cols, F.explode_outer(later).alias("r"))
                .where(F.col("user_id").isNull() | self.bit_set("r"))
                .select("user_id", "a", "r"))


def activity_state(payments_clean: DataFrame, as_of: str, start: str = ACTIVITY_START,
                   states: Sequence[str] = ACTIVE_PAYMENT_STATES) -> DataFrame:
    """The month masks of every user as a table to keep: ``user_id, mask0, ...``,
    bit i of the masks standing for month i after ``start`` (:data:`MASK_BITS`
    to a mask). Payments without an owner are the row with a NULL user."""
    return _Masks(payments_clean, as_of, start, states).df


def merge_states(*tables: DataFrame) -> DataFrame:
    """Masks of several tables of one ``start`` in one. OR is idempotent, so the
    tables may cover the same payments; a table of an earlier date may have fewer
    masks."""
    cols = sorted({c for t in tables for c in t.columns if c != "user_id"}, key=lambda c: int(c.removeprefix("mask")))
    out = None
    for t in tables:
        one = t.select("user_id", *[F.col(c) if c in t.columns else F.lit(0).cast("bigint").alias(c) for c in cols])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("user_id").agg(*[F.bit_or(c).alias(c) for c in cols])


def advance_state(stored: DataFrame, payments_clean: DataFrame, since: str, as_of: str, start: str = ACTIVITY_START,
                  states: Sequence[str] = ACTIVE_PAYMENT_STATES) -> DataFrame:
    """The state as of ``as_of`` from the one stored as of ``since``.

    Only payments created from the last month of the stored window on are read
    (its upper bound is the month's first instant); the range reaches the scan.
    Older payments that became settled or initiated since are not seen: give
    those rows to :func:`activity_state` and merge its table too.
    """
    last = month_start(to_pst(as_of_lit(since))) + F.make_dt_interval(hours=F.lit(PST_OFFSET_HOURS))
    recent = payments_clean.where(F.col("payment_created_at_utc") >= last)
    return merge_states(stored, activity_state(recent, as_of, start, states))


def counts_from_state(state: DataFrame, as_of: str, start: str = ACTIVITY_START) -> DataFrame:
    """A21 from a stored state, which must not be newer than ``as_of``."""
    return _count(_Masks(state, as_of, start, (), stored=state))


def _count(m: _Masks) -> DataFrame:
    return (m.pairs()
            .groupBy(m.month("a").alias("activity"), (F.col("r") - F.col("a")).alias("diff"))
            .agg(F.count("user_id").alias("retained")))


def activity_pairs(payments_clean: DataFrame, as_of: str, start: str = ACTIVITY_START,
                   states: Sequence[str] = ACTIVE_PAYMENT_STATES) -> DataFrame:
    """Each (user, active month) with each same-or-later active month of
    the same user and the month offset (AGE in months, exact here since both
    are month starts); ownerless rows keep NULLs."""
    m = _Masks(payments_clean, as_of, start, states)
    return m.pairs().select(
        "user_id", m.month("a").alias("activity"), m.month("r").alias("futureActivity"),
        (F.col("r") - F.col("a")).alias("diff"))


def cohort_counts(payments_clean: DataFrame, as_of: str, start: str = ACTIVITY_START,
                  states: Sequence[str] = ACTIVE_PAYMENT_STATES) -> DataFrame:
    """Distinct users per (cohort month, offset). A month with ownerless
    payments also gets the row (month, NULL, 0): counting user ids skips the
    ownerless group's NULL id."""
    return _count(_Masks(payments_clean, as_of, start, states))


def cohort_retention(counts: DataFrame) -> DataFrame:
    """Cohort size (retained at the first offset, NULL offsets last) and
    the retention rate. A cohort whose size is 0 (only ownerless payments) gets
    a NULL rate instead of a division error."""
    w = Window.partitionBy("activity").orderBy(F.col("diff").asc_nulls_last())
    total = F.first("retained").over(w)
    return counts.select(
        "activity", "diff", "retained",
        total.alias("total"),
        (F.col("retained").cast("double") / F.nullif(total, F.lit(0)).cast("double"))
        .alias("retention_rate"),
    )
