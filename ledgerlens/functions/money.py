"""Money stored as integer cents, reported as exact decimal currency."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.util import as_col

# decimal(2,2), so ``cents * 0.01`` stays exact (decimal(23,2) for bigint).
# A float literal would turn every amount into a double.
CENT = Decimal("0.01")


def usd(cents) -> Column:
    """``cents * 0.01`` as an exact decimal; NULL stays NULL."""
    return as_col(cents).cast("bigint") * F.lit(CENT)


def usd_or_zero(cents) -> Column:
    """``COALESCE(cents * 0.01, 0)``."""
    return F.coalesce(usd(cents), F.lit(Decimal("0.00")))
