"""Quality rules with thresholds learned from the corpus (operator 13).

Each text gives counts (words, symbols, repeated lines, words in repeated
windows) and from them four rates as whole numbers. Two base rules are fixed:
a text of too few words or of too many repeated words fails. The others are
judged by fences around the middle of the rates of texts of the same language
and source.

Quantile sketches. The sketch of a set of texts has one row for each rate and
bucket of values: a bucket holds values that agree in their highest
``SKETCH_BITS`` bits, so a quantile is off by less than one in
``2 ** (SKETCH_BITS - 1)`` and a sketch has at most some hundred rows a rate,
however many texts it is of. Sketches merge by adding counts: those of a language
and source are partial counts of all tasks, summed; those of a language, and of
all texts, are sums of them. A pair of language and source with fewer than
``min_texts`` texts takes the fences of its language, and a language with fewer
those of all texts.

The fences join the texts' rates by language and source. A pair that holds a
third of all texts is salted: every fence row stands once for each of
``SALTS`` salts, and a text's salt is a hash of its id. Only numbers move, never
texts; all of it is DataFrame functions.

Results in odd cases. A null or empty text has zero counts and fails. Null
languages and null sources are groups like others. Rows are judged one by one, so
repeated rows each give a row; a null doc_id stays null. Rates equal to a
fence pass. Columns beyond doc_id, text, lang and source are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.common import WORD, shared_path

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SKETCH_BITS = 6
MIN_TEXTS = 200
SALTS = 16


@dataclass(frozen=True)
class Rate:
    """A rate and its fences: the upper one lies ``reach`` times the distance
    from the median to the upper quartile (``unit`` at least) above that
    quartile; the lower one, where there is one, mirrors it."""

    name: str
    sql: str
    unit: int
    reach: int = 4
    lower: bool = False


RATES = (
    Rate("word_length", "100 * word_chars div n_words", 15, 10, lower=True),
    Rate("symbols", "1000 * n_symbols div n_words", 25),
    Rate("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 100),
    Rate("repeat_words", "1000 * n_repeat_words div n_words", 50),
)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each text, in one pass.

    Repeated windows are found by 64-bit hashes: those of ``window`` words (a
    power of two) come from pairs of hashes of half as many, and only a text in
    which enough of those repeat goes on to the whole windows and sorts them.
    Its repeated windows, in order of place, then cover ``window`` words each,
    less what they share with the next.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text")).select(
        "doc_id", "lang", "source", F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols", F.size("words").alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("windows"))

    def doubled(step: int) -> Column:
        """Hashes of ``2 * step`` words; the last ones, of fewer, stay until the end."""
        later = F.slice("windows", step + 1, F.greatest(F.size("windows"), F.lit(1)))
        return F.zip_with("windows", later, lambda a, b: F.xxhash64(a, b))

    half = window // 2
    for step in (2 ** k for k in range(half.bit_length() - 1)):
        rows = rows.withColumn("windows", doubled(step))
    # The later of two equal windows holds half + 1 half windows seen before.
    rows = rows.withColumn("windows", F.when(
        F.size("windows") - F.size(F.array_distinct("windows")) > half,
        F.slice(doubled(half), 1, F.greatest(F.col("n_words") - (window - 1), F.lit(0)))))
    rows = rows.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))))

    def hash_at(k: Column) -> Column:
        return F.get("sorted", k).getField("hash")

    repeated = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
    rows = rows.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(repeated, lambda k: F.get("sorted", k).getField("place")))))
    covered = F.aggregate(
        F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))),
        F.lit(0), lambda x, y: x + y)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return rows.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in _COUNTS])


def _bucket(value: str) -> Column:
    """The least value that agrees with ``value`` in its highest bits."""
    shift = f"greatest(length(bin({value})) - {SKETCH_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(rated: DataFrame) -> DataFrame:
    """``lang, source, rate, bucket, n``: sketches of each language and source
    from rows with a column for every rate."""
    pairs = ", ".join(f"'{r.name}', {r.name}" for r in RATES)
    values = rated.select("lang", "source", F.expr(f"stack({len(RATES)}, {pairs}) as (rate, value)"))
    return values.groupBy("lang", "source", "rate", _bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up by ``keys``."""
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``keys, rate, n, q1, q2, q3`` of sketches."""
    by = W.partitionBy(*keys, "rate")
    summed = sketch.select(*keys, "rate", "bucket", F.sum("n").over(by.orderBy("bucket")).alias("reached"), F.sum("n").over(by).alias("n"))
    return summed.groupBy(*keys, "rate", "n").agg(*[F.min(F.when(4 * F.col("reached") >= k * F.col("n"), F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)])


def _fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """``keys, rate, n, low, high``."""
    found = quartiles(sketch, *keys)
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for r in RATES:
        mine = F.col("rate") == r.name
        high = F.when(mine, F.col("q3") + r.reach * F.greatest(F.col("q3") - F.col("q2"), F.lit(r.unit))).otherwise(high)
        if r.lower:
            low = F.when(mine, F.col("q1") - r.reach * F.greatest(F.col("q2") - F.col("q1"), F.lit(r.unit))).otherwise(low)
    return found.select(*keys, "rate", "n", low.alias("low"), high.alias("high"))


def fences(sketch: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """One row a language and source: ``low_<rate>`` and ``high_<rate>``, from
    the least group of at least ``min_texts`` texts that holds it."""
    own = _fences(sketch, "lang", "source")
    lang = _fences(merged(sketch, "lang"), "lang").select(F.col("lang").alias("of"), F.col("rate").alias("lang_rate"), *[F.col(c).alias(f"lang_{c}") for c in ("n", "low", "high")])
    every = _fences(merged(sketch)).select(F.col("rate").alias("all_rate"), *[F.col(c).alias(f"all_{c}") for c in ("low", "high")])
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("rate") == F.col("lang_rate"))).join(every, F.col("rate") == F.col("all_rate"))

    def chosen(c: str) -> Column:
        return F.when(F.col("n") >= min_texts, F.col(c)).when(F.col("lang_n") >= min_texts, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))

    rows = rows.select("lang", "source", "rate", chosen("low").alias("low"), chosen("high").alias("high"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r.name, F.col(c))).alias(f"{c}_{r.name}") for r in RATES for c in ("low", "high")])


def _key(c: str) -> Column:
    """A column that is equal where ``c`` is, nulls included."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def judged(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_texts: int = MIN_TEXTS) -> DataFrame:
    """One row a row of ``docs``: ``doc_id``, the counts, ``base_failed``,
    ``kept`` and ``failed``, the names of rates beyond a fence."""
    spark = docs.sparkSession
    path = shared_path(spark, "quality-counts")
    counted(docs).write.parquet(path)
    rows = spark.read.parquet(path).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    rated = rows.withColumns({r.name: F.when(~F.col("base_failed"), F.expr(r.sql)) for r in RATES})
    limits = fences(sketches(rated.where(~F.col("base_failed"))), min_texts)
    limits = limits.select(
        _key("lang").alias("lang_key"), _key("source").alias("source_key"), *[c for c in limits.columns if c not in ("lang", "source")],
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rated.withColumns({
        "lang_key": _key("lang"), "source_key": _key("source"), "salt": F.pmod(F.xxhash64("doc_id", *_COUNTS), F.lit(SALTS)).cast("int")})
    joined = salted.join(limits, ["lang_key", "source_key", "salt"], "left")
    beyond = F.array_compact(F.array(*[
        F.when((F.col(r.name) > F.col(f"high_{r.name}")) | F.coalesce(F.col(r.name) < F.col(f"low_{r.name}"), F.lit(False)), F.lit(r.name)) for r in RATES]))
    return joined.withColumn("failed", beyond).select(
        "doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
