"""Keys that hold very many rows, measured before a plan is built.

The skew-safe shapes of :mod:`ledgerlens.plans.joins` and
:mod:`ledgerlens.plans.windows` cost more than the plain ones, and few tables
have a key that needs them. ``hot_keys`` finds such keys with a frequent-items
sketch: one scan of the key columns with a partial aggregate of fixed size, no
shuffle of the keys. The shapes then treat the rows of those keys apart and all
others plainly.

The sketch tracks ``TRACKED`` items, so a key with more than some 4 / TRACKED of
all rows is always found; what is found besides only costs time, as both shapes
give the same rows. At most ``MOST`` keys come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task should handle at most.
HOT_ROWS = 1_000_000
TRACKED = 8192
MOST = 1000


def _known(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def hot_keys(rows: DataFrame, *keysets: Sequence[str], hot_rows: int = HOT_ROWS) -> list[list[tuple]]:
    """For each set of key columns the keys (no part NULL) with more than
    ``hot_rows`` of ``rows``, the fullest first. One job; a second one names the
    keys of sets of several columns, whose hashes the sketch counts."""
    def item(keys: Sequence[str]) -> Column:
        value = F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)
        return F.when(_known(keys), value)

    items = rows.select(*[item(ks).alias(f"k{i}") for i, ks in enumerate(keysets)])
    found = items.agg(*[F.expr(f"approx_top_k(k{i}, {MOST}, {TRACKED})").alias(f"t{i}") for i in range(len(keysets))]).first()
    out = []
    for ks, top in zip(keysets, found, strict=True):
        values = [r["item"] for r in top if r["item"] is not None and r["count"] > hot_rows]
        if len(ks) == 1 or not values:
            out.append([(v,) for v in values])
        else:
            named = rows.where(_known(ks) & F.xxhash64(*ks).isin(values)).groupBy(*ks).count().where(F.col("count") > hot_rows)
            out.append([tuple(r)[:-1] for r in named.orderBy(F.desc("count"), *ks).limit(MOST).collect()])
    return out


def is_hot(keys: Sequence[str], hot: Sequence[tuple]) -> Column:
    """Whether a row has one of the ``hot`` keys (false where a part is NULL)."""
    if not hot:
        return F.lit(False)
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([k[0] for k in hot]), F.lit(False))
    return F.coalesce(_known(keys) & F.struct(*keys).isin([F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, key, strict=True)]) for key in hot]), F.lit(False))
