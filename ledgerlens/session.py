"""SparkSession construction with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators rely on for correct results (UTC wall clock, ANSI
# arithmetic) and for scale (AQE re-planning, skew-join splitting).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # A shuffle partition above 4x the median (and the byte threshold) is
    # split, including the NULL-key partition of an outer join's preserved side.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # No operator broadcasts by hand: a join side is broadcast only when its
    # size (estimated, then measured at runtime by AQE) is under this bound,
    # otherwise the join shuffles. Spark's default, stated explicitly.
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "ledgerlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with :data:`BASE_CONF` applied.

    On a cluster leave ``master`` unset so the launcher decides; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # An existing session keeps its static settings; SQL settings are applied
    # to it at runtime.
    for key, value in conf.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark

