"""Source tables: readers for the ten payment-domain tables.

``read_sources`` reads them as parquet from one folder (one sub-folder per
table) the way a deployment would; ``fixture_sources`` derives them from the
driver's TPC-H-like test tables with the rules in :mod:`.fixtures`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources import fixtures
from ledgerlens.sources.schemas import declared

SOURCE_TABLES = (
    "payments", "users", "funds", "contributors", "contributions", "transactions",
    "stripe_transactions", "ach_transactions", "affiliate_links", "affiliate_commissions",
)


class Sources:
    """Lazily built source tables; each attribute is a DataFrame."""

    def __init__(self, loader):
        self._loader = loader
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SOURCE_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._loader(name)
        return self._cache[name]


def read_sources(spark: SparkSession, base_path: str) -> Sources:
    """The tables of a warehouse folder, with their declared columns and types."""
    return Sources(lambda name: declared(spark.read.parquet(f"{base_path}/{name}"), name))


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_sources(spark: SparkSession, sf_dir: str) -> Sources:
    def load(name: str) -> DataFrame:
        t = lambda n: driver_table(spark, sf_dir, n)
        builders = {
            "payments": lambda: fixtures.payments(t("orders")),
            "users": lambda: fixtures.users(t("customer")),
            "funds": lambda: fixtures.funds(t("customer")),
            "contributors": lambda: fixtures.contributors(t("orders")),
            "contributions": lambda: fixtures.contributions(t("orders")),
            "transactions": lambda: fixtures.transactions(t("lineitem")),
            "stripe_transactions": lambda: fixtures.stripe_transactions(t("lineitem")),
            "ach_transactions": lambda: fixtures.ach_transactions(t("lineitem")),
            "affiliate_links": lambda: fixtures.affiliate_links(t("supplier")),
            "affiliate_commissions": lambda: fixtures.affiliate_commissions(t("part")),
        }
        return builders[name]()
    return Sources(load)
