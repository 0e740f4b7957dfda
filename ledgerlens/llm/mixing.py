"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

Every document gets an exponential key: minus the logarithm of a uniform hash of
its id, over its quality weight. Within a source the smallest keys come first.
Complete epochs of a source precede a fractional selection, which takes
documents in key order until the prefix sum of their sizes reaches the rest of
the token budget. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Key intervals a source is cut into, so that a prefix sum over one source
#: never sorts more than one interval's documents in one task.
INTERVALS = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's quality weight in [0.25, 1]: near 1 for words of four to
    eight characters on average, less for other texts and for empty ones."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.abs(mean - 6.5) / 10.0)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by '|' (nulls empty):
    52 bits, the same on every run and machine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` for rows ``source, size``.

    Sources by code point (null last) weigh ``weights``, repeating, and share the
    total of all sizes; a target stops at ``max_epochs`` times its source's size,
    and the excess goes to the others by weight until none is above. With the
    sources in order of cap over weight, those that stop are a prefix, so one
    pass of prefix sums over the sources finds the shares.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    rank = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = rank.rowsBetween(W.unboundedPreceding, -1), rank.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    # The first source that takes less than its cap sets the level for the rest.
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)
    target = F.when(free.isNull() | (F.col("ratio") < free.getField("ratio")), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * free.getField("level")))
    return by.withColumn("target", target.cast("double")).select("source", "source_size", "weight", "target")


def sampled(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
            intervals: int = INTERVALS, carry: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, times`` (and ``carried``, the
    column ``carry``): how often the mix takes each row of ``docs``.

    Null texts have size 0; documents of size 0 are taken in complete epochs
    only. A null source is a source of its own. Rows with equal id and size
    are ordered arbitrarily among themselves, being alike. An empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    text, size = F.col("text"), word_count(F.col("text"))
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        (-F.log(uniform(F.lit(seed), F.col("doc_id"))) / quality_weight(text, size)).alias("key"),
        *([carry.alias("carried")] if carry is not None else []))
    # 1 - exp(-key) grows with the key from 0 to 1, so intervals keep its order.
    rows = rows.withColumn("interval", F.least(F.floor((1 - F.exp(-F.col("key"))) * intervals), F.lit(intervals - 1)).cast("int"))
    sums = rows.groupBy("source", "interval").agg(F.sum("size").alias("interval_size"))
    size_of, share = F.col("source_size"), F.col("target") / F.col("source_size")
    targets = source_targets(sums.select("source", F.col("interval_size").alias("size")), weights, max_epochs) \
        .withColumn("epochs", F.when(size_of > 0, F.floor(share + 1e-12)).otherwise(1).cast("int")) \
        .withColumn("rest", F.when(size_of > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * size_of)).otherwise(0.0))
    upto = W.partitionBy("source").orderBy("interval").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("interval_size").over(upto), F.lit(0))).withColumnRenamed("source", "of_source")
    # One row a source: the interval in which its budget ends.
    plan = starts.join(targets, F.col("of_source").eqNullSafe(F.col("source"))) \
        .groupBy("of_source", "source_size", "target", "epochs", "rest").agg(
            F.min(F.when(F.col("before") + F.col("interval_size") > F.col("rest"), F.struct("interval", "before"))).alias("end"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of_source")), "left")
    out = ["doc_id", "source", "size", "source_size", "target", *(["carried"] if carry is not None else [])]
    times = (F.col("epochs") + F.col("extra")).cast("int").alias("times")
    at_end = F.coalesce(F.col("interval") == F.col("end.interval"), F.lit(False))
    # Only the interval that the budget ends in needs the order of its rows.
    run = W.partitionBy("of_source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = F.col("end.before") + F.sum("size").over(run)
    # The document that crosses the budget is taken if that ends nearer to it.
    edge = rows.where(at_end).withColumn("extra", ((F.col("size") > 0) & (2 * reached - F.col("size") <= 2 * F.col("rest"))).cast("int"))
    sure = (F.col("size") > 0) & (F.col("end").isNull() | (F.col("interval") < F.col("end.interval")))
    other = rows.where(~at_end).withColumn("extra", sure.cast("int"))
    return edge.select(*out, times).unionByName(other.select(*out, times))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often
    as it is taken."""
    rows = sampled(docs, weights, max_epochs, seed, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    again = rows.where("times > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    return again.select("carried.*")
