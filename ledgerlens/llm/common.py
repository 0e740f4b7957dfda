"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what lies between spaces, tabs, line feeds, vertical tabs, form
#: feeds and carriage returns (Java and RE2 syntax). ``bytes.split()`` without
#: arguments cuts UTF-8 at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def share_library(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; on a
    cluster it is installed, and the path does no harm."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``, by any path that Spark reads."""
    share_library(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a new folder on this machine if Spark runs on
    this machine alone (tests); on a cluster that raises, since executors would
    not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
    if not root and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not root:
        root = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from reliable checkpoint files; survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dealt(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """``df`` dealt by ``key``, from reliable checkpoint files that count as dealt:
    to group them by ``key`` writes no other shuffle of them. An adaptive plan
    does not tell how its result is dealt, so this one plan is a plain one."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(partitions, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def drop_unused(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files, and checkpoints where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, that nothing
    refers to any more. It learns of them from the driver's garbage collection,
    which a driver with little to do may not run for long. What Python lets go of
    is let go in the JVM by a thread of py4j that looks every second."""
    gc.collect()
    time.sleep(2)
    spark.sparkContext._jvm.System.gc()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, for a written table."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(key: str, modulus: int):
    """crc32 of column ``key`` as text, modulo ``modulus`` (null: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def sample_hash(rows: DataFrame, bound: int, salt: int, *columns: str) -> tuple[Column, Column]:
    """A hash of ``columns`` and the condition that it is among the ``bound``
    least distinct ones of ``rows`` (all, where there are fewer).

    Rows that repeat their columns share a hash, so a caller that wants at most
    ``bound`` rows drops repeats of the hash; no id that a third of all rows
    share can crowd others out. Only hashes below a threshold that about four
    times the bound fall under are made distinct; it is raised as long as repeats
    leave too few.
    """
    scale = 1 << 40
    h = F.abs(F.xxhash64(*[F.col(c).cast("string") for c in columns], F.lit(salt)) % F.lit(scale))
    hashes = rows.select(h.alias("h"))
    n = rows.count()
    below = min(scale, max(1, 4 * bound * scale // max(1, n)))
    while True:
        found = hashes.where(F.col("h") < below).distinct().orderBy("h").limit(bound).agg(F.count("h"), F.max("h")).first()
        if found[0] >= bound or below >= scale:
            return h, h <= F.lit(-1 if found[1] is None else found[1])
        below = min(scale, below * 16)


def release_memory() -> None:
    """Give what a task held back to the system. Python workers live on after a
    task, and an executor counts what they keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that ``column`` holds about
    ``limit`` bytes in each; a longer value stands alone. Bounds what a Python
    worker tokenises at a time; nothing is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
