"""Window shapes that stay balanced when one partition key is very hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans.hotkeys import is_hot

def lead_measured(df: DataFrame, partition_by: Sequence[str], bucket_by: Sequence[str], order_by: Sequence[str],
                  values: dict[str, str], hot: Sequence[tuple]) -> DataFrame:
    """:func:`lead_in_order` for the rows of the ``hot`` partition keys (see
    :mod:`ledgerlens.plans.hotkeys`) and one plain window for all others. The
    split is a filter on the key, which reaches the scans of either branch."""
    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*partition_by).orderBy(*[F.col(c).asc_nulls_last() for c in [*bucket_by, *order_by]])
        return rows.select("*", *[F.lead(F.col(v), 1).over(w).alias(o) for o, v in values.items()])

    if not hot:
        return plain(df)
    apart = is_hot(list(partition_by), hot)
    return plain(df.where(~apart)).unionByName(lead_in_order(df.where(apart), partition_by, bucket_by, order_by, values))


def lead_in_order(df: DataFrame, partition_by: Sequence[str], bucket_by: Sequence[str],
                  order_by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Add ``LEAD(value, 1) OVER (PARTITION BY partition_by ORDER BY bucket_by,
    order_by)`` for every ``out_name -> value`` of ``values``; all ordering is
    ascending with NULLs last and must be unique within a partition.

    ``bucket_by`` are columns that are monotone in that order, coarse to fine
    (for example the month and an id range). A plain window would send every row
    of a hot partition key to one task; here the work is split in levels:

    1. a window per (partition, all bucket columns) gives each row the next row
       inside its bucket and flags the bucket's first and last rows;
    2. the first and last rows of the buckets go on to a window with one bucket
       column less, in which a bucket's last row is directly followed by the
       next bucket's first row, and so on up to the partition key alone;
    3. a row takes its LEAD from the first level at which it is not the last.

    The levels are joined by UNION ALL; the first reads the input through one
    shared exchange. A window above the first holds at most two rows of each
    bucket below it. Buckets of a single row give no reduction at their own
    level (with one payment a month and user, the id ranges split nothing), but
    the last window never holds more than two rows of each value of the first
    bucket column.

    The result equals the single window exactly, including NULL values of the
    next row. Partition and bucket columns must not be NULL (map a nullable
    bucket to a sentinel that sorts last before calling).
    """
    partition_by, bucket_by, order_by = list(partition_by), list(bucket_by), list(order_by)
    outs = list(values)
    own = df.columns
    # An input already hash-partitioned by the partition key alone (say, after
    # a sort-merge join on it) would satisfy the window's distribution and keep
    # a hot key in one task; repartitioning on the full bucket key prevents it.
    rows = df.repartition(*partition_by, *bucket_by)
    done = []
    for level in range(len(bucket_by), -1, -1):
        group = [*partition_by, *bucket_by[:level]]
        window = Window.partitionBy(*group).orderBy(
            *[F.col(c).asc_nulls_last() for c in [*bucket_by[level:], *order_by]])
        led = rows.select(
            "*", *[F.lead(F.col(values[o]), 1).over(window).alias(f"__lead_{o}") for o in outs],
            F.lead(F.lit(1), 1).over(window).isNull().alias("__last"),
            (F.row_number().over(window) == 1).alias("__first"))
        # Rows that are not the last of a bucket below have their LEAD already.
        mine = F.lit(True) if level == len(bucket_by) else F.col("__open")
        settled = ~F.col("__last") if level else F.lit(True)
        done.append(led.where(mine & settled).select(*own, *[F.col(f"__lead_{o}").alias(o) for o in outs]))
        rows = led.where(F.col("__first") | F.col("__last")).select(*own, (mine & F.col("__last")).alias("__open"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
