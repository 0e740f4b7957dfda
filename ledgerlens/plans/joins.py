"""Join shapes that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.hotkeys import is_hot

def left_join_measured(one: DataFrame, many: DataFrame, keys: Sequence[str], hot: Sequence[tuple]) -> DataFrame:
    """``one LEFT JOIN many USING (keys)`` for a left side that holds each key
    at most once and a right side whose ``hot`` keys are known (see
    :mod:`ledgerlens.plans.hotkeys`).

    Rows of the hot keys are joined apart: the left side has at most one row for
    each of the keys in the list, so it is broadcast, and the right side's many
    rows stay where they are read. All others take one plain LEFT JOIN, in which
    no key of the right side is hot; adaptive execution can split the left side,
    which covers many rows with a NULL key. A key that is listed but does not
    occur in ``many`` keeps its NULL-padded row.
    """
    keys = list(keys)
    right_only = [c for c in many.columns if c not in keys]
    renamed = many.select(*[F.col(k).cast(one.schema[k].dataType).alias(f"__key_{i}") for i, k in enumerate(keys)], *right_only)
    names = [f"__key_{i}" for i in range(len(keys))]
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & (F.col(k) == F.col(n))
    if not hot:
        return one.join(renamed, on, "left").select(*one.columns, *right_only)
    hot_one, hot_many = is_hot(keys, hot), is_hot(names, hot)
    cold = one.where(~hot_one).join(renamed.where(~hot_many), on, "left").select(*one.columns, *right_only)
    apart = renamed.where(hot_many).join(F.broadcast(one.where(hot_one)), on, "inner").select(*one.columns, *right_only)
    missing = one.where(hot_one).join(renamed.where(hot_many).select(*names).distinct(), on, "left_anti")
    padding = [F.lit(None).cast(many.schema[c].dataType).alias(c) for c in right_only]
    return cold.unionByName(apart).unionByName(missing.select(*one.columns, *padding))


#: Values of the hashed second join key; it carries no information of its own.
_SPREAD = 1023


def left_join_fanout(one: DataFrame, many: DataFrame, keys: Sequence[str], spread_nulls_by: Column | None = None,
                     many_keys: DataFrame | None = None) -> DataFrame:
    """``one LEFT JOIN many USING (keys)`` for a left side that holds each key
    at most once and a right side that may hold a key very often.

    Adaptive execution splits a skewed partition only on the side whose rows
    may be duplicated freely: both sides of an inner join, but only the
    preserved side of an outer join. A hot key on the right of a LEFT JOIN would
    therefore stay in one task. Written as

        (one INNER JOIN many)  UNION ALL  (one ANTI JOIN distinct keys of many, NULL-padded)

    the inner join can be split, and the anti join only sees the distinct keys
    (partially aggregated on the map side, so a hot key ships once per map
    task).

    It can be split only if both its sides are read from an exchange. An input
    that is already partitioned by the keys would not be exchanged again, so the
    join uses one more key, a hash of the others, by which no input is
    partitioned. Rows of ``one`` with a NULL key get a hash that no row of
    ``many`` has and are dealt by ``spread_nulls_by`` (default: a hash of the
    row), so both branches read all of ``one`` alike and share its exchange.
    Rows of ``many`` with a NULL key never match and are dropped. ``many_keys``
    names a cheaper relation with the same keys for the anti join.
    """
    keys = list(keys)
    spread = F.xxhash64(*one.columns) if spread_nulls_by is None else spread_nulls_by
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hashed = F.xxhash64(*keys).bitwiseAND(F.lit(_SPREAD))
    names = [f"__key_{i}" for i in range(len(keys))]

    def filled(k: str, i: int) -> Column:
        kind = one.schema[k].dataType
        zero = F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)
        return F.coalesce(F.col(k), spread.cast(kind), zero) if i == 0 else F.coalesce(F.col(k), zero)

    left = one.withColumns({
        **{n: filled(k, i) for i, (n, k) in enumerate(zip(names, keys, strict=True))},
        "__hash": F.when(known, hashed).otherwise(F.lit(-1).cast("long"))})

    def right(df: DataFrame, *columns: str) -> DataFrame:
        cast = [F.col(k).cast(one.schema[k].dataType).alias(n) for n, k in zip(names, keys, strict=True)]
        return df.where(known).select(*cast, hashed.alias("__hash"), *columns)

    right_only = [c for c in many.columns if c not in keys]
    padding = [F.lit(None).cast(many.schema[c].dataType).alias(c) for c in right_only]
    matched = left.join(right(many, *right_only), [*names, "__hash"], "inner").select(*one.columns, *right_only)
    distinct = right(many if many_keys is None else many_keys).distinct()
    missing = left.join(distinct, [*names, "__hash"], "left_anti").select(*one.columns, *padding)
    return matched.unionByName(missing)
