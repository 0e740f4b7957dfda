"""The registered queries of this subpackage: one opN_<name> for each operator.

Each takes (spark, sf_dir), applies its operator with production parameters to
its whole table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    ann, chat_preferences, decontaminate, hard_negatives, langid, mixing, pii, pitman_yor, quality, quality_rules, simhash_dedup, token_alignment, token_store)
from ledgerlens.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "bits")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s.getField("kind") == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k.name) for k in pii.BASE_KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).alias("n_added"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.getField("score"))), F.lit(0.0)).alias("top_score"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.dedup_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair, for every k."""
    turns = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
    pairs = chat_preferences.preference_pairs(turns)

    def digest(c: str):
        return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")

    return pairs.select(
        "pair_id", "status", "prefix_turns", digest("prompt"), digest("chosen"), digest("rejected"),
        chat_preferences.joined_mask(F.col("chosen_mask")).alias("chosen_mask"), chat_preferences.joined_mask(F.col("rejected_mask")).alias("rejected_mask"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sampled(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 100. Where vec_id is divisible by 7 the label
    is the next of ten, so that some negatives are near."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, label=label)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_ann, op3_pitman_yor, op4_pii, op5_token_shards, op6_simhash_dedup, op7_chat_preferences, op8_quality, op9_mixing, op10_langid,
                              op11_hard_negatives, op12_token_alignment, op13_quality_rules)
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_chat_preferences": """
WITH turns AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS is_chosen, turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, is_chosen ORDER BY turn NULLS FIRST, role, text) AS place,
         '<|' || role || '|>' || chr(10) AS head, head || text || '<|end|>' || chr(10) AS rendered
  FROM turns),
agreed AS (
  SELECT pair_id, place, count(*) FILTER (is_chosen) AS c, count(*) FILTER (NOT is_chosen) AS r,
         c = r AND count(DISTINCT rendered) = 1 AND count(DISTINCT role) = 1 AS same
  FROM placed GROUP BY pair_id, place),
pairs AS (
  SELECT pair_id, sum(c) AS n_c, sum(r) AS n_r,
         CASE WHEN n_c = 0 THEN n_r WHEN n_r = 0 THEN n_c ELSE coalesce(min(place) FILTER (NOT same) - 1, n_c) END AS n
  FROM agreed GROUP BY pair_id),
completed AS (
  SELECT p.*, n, sum(length(rendered)) OVER (PARTITION BY pair_id, is_chosen ORDER BY place) AS stop
  FROM placed p JOIN pairs USING (pair_id) WHERE place > n),
sides AS (
  SELECT pair_id, is_chosen, string_agg(rendered, '' ORDER BY place) AS text,
         string_agg((stop - length(rendered) + length(head)) || ':' || (stop - 1), ',' ORDER BY place) FILTER (role = 'assistant') AS mask
  FROM completed GROUP BY pair_id, is_chosen),
prompts AS (
  SELECT pair_id, string_agg(rendered, '' ORDER BY place) AS text FROM placed JOIN pairs USING (pair_id)
  WHERE place <= n AND (is_chosen OR n_c = 0) GROUP BY pair_id)
SELECT q.pair_id,
       CASE WHEN n_c = 0 THEN 'rejected_only' WHEN n_r = 0 THEN 'chosen_only' WHEN n_c = n AND n_r = n THEN 'identical' ELSE 'pair' END AS status,
       CAST(n AS INTEGER) AS prefix_turns, md5(coalesce(p.text, '')) AS prompt_md5, md5(coalesce(c.text, '')) AS chosen_md5,
       md5(coalesce(r.text, '')) AS rejected_md5, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM pairs q
LEFT JOIN prompts p ON p.pair_id = q.pair_id
LEFT JOIN sides c ON c.pair_id = q.pair_id AND c.is_chosen
LEFT JOIN sides r ON r.pair_id = q.pair_id AND NOT r.is_chosen
""",
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) / greatest(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0), 1)::DOUBLE AS mean,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
-- What all would take at the level at which each source stops.
stops AS (
  SELECT a.cap / a.weight AS level, sum(least(b.cap, a.cap / a.weight * b.weight)) AS takes FROM sources a, sources b GROUP BY a.source, level),
low AS (
  SELECT coalesce((SELECT max(level) FROM stops WHERE takes <= (SELECT sum(source_size) FROM sources) * (1 + 1e-12)), 0) AS below),
level AS (
  SELECT (sum(source_size) - coalesce(sum(cap) FILTER (cap / weight <= below), 0)) / nullif(sum(weight) FILTER (cap / weight > below), 0) AS x
  FROM sources, low),
targets AS (
  SELECT source, source_size, coalesce(least(cap, x * weight), cap) AS target,
         CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 1 END AS epochs,
         CASE WHEN source_size > 0 THEN greatest(0.0, target - epochs * source_size) ELSE 0 END AS rest
  FROM sources, level),
ordered AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / greatest(0.25, 1 - abs(mean - 6.5) / 10), doc_id, size ROWS UNBOUNDED PRECEDING) AS reached
  FROM sized)
SELECT doc_id, size, source_size, target, o.source, CAST(epochs + (size > 0 AND 2 * reached - size <= 2 * rest)::INT AS INTEGER) AS times,
       CAST(size * times AS BIGINT) AS taken
FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source
""",
    "op11_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op13_quality_rules": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM texts),
repeated AS (SELECT r, p FROM places QUALIFY count(*) OVER (PARTITION BY r, w[p:p + 7]) > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM repeated) GROUP BY r),
counts AS (
  SELECT doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
  FROM texts LEFT JOIN covered USING (r)),
rates AS (
  SELECT *, unnest([{'rate': 'word_length', 'value': 100 * word_chars // n_words}, {'rate': 'symbols', 'value': 1000 * n_symbols // n_words},
                    {'rate': 'dup_lines', 'value': 1000 * n_dup_lines // greatest(n_lines, 1)},
                    {'rate': 'repeat_words', 'value': 1000 * n_repeat_words // n_words}], recursive := true)
  FROM counts WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, rate, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket, count(*) AS n
  FROM rates GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, rate FROM sketch),
-- Each group's own sketch, that of its language and that of all texts.
levels AS (
  SELECT g.lang, g.source, g.rate, 1 AS level, s.bucket, s.n FROM groups g JOIN sketch s ON g.rate = s.rate AND g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT g.lang, g.source, g.rate, 2, s.bucket, s.n FROM groups g JOIN sketch s ON g.rate = s.rate AND g.lang IS NOT DISTINCT FROM s.lang
  UNION ALL SELECT g.lang, g.source, g.rate, 3, s.bucket, s.n FROM groups g JOIN sketch s ON g.rate = s.rate),
reached AS (
  SELECT lang, source, rate, level, bucket, sum(n) OVER (PARTITION BY lang, source, rate, level ORDER BY bucket) AS up_to,
         sum(n) OVER (PARTITION BY lang, source, rate, level) AS total
  FROM levels),
quartiles AS (
  SELECT lang, source, rate, level, total, min(bucket) FILTER (4 * up_to >= total) AS q1, min(bucket) FILTER (4 * up_to >= 2 * total) AS q2,
         min(bucket) FILTER (4 * up_to >= 3 * total) AS q3
  FROM reached GROUP BY ALL),
chosen AS (
  SELECT * FROM quartiles WHERE level = 3 OR total >= 200 QUALIFY row_number() OVER (PARTITION BY lang, source, rate ORDER BY level) = 1),
fences AS (
  SELECT lang, source, rate, q3 + reach * greatest(q3 - q2, unit) AS high, CASE WHEN rate = 'word_length' THEN q1 - reach * greatest(q2 - q1, unit) END AS low
  FROM chosen JOIN (VALUES ('word_length', 15, 10), ('symbols', 25, 4), ('dup_lines', 100, 4), ('repeat_words', 50, 4)) AS r (rate, unit, reach) USING (rate)),
wide AS (
  SELECT lang, source, max(low) AS low, max(high) FILTER (rate = 'word_length') AS h1, max(high) FILTER (rate = 'symbols') AS h2,
         max(high) FILTER (rate = 'dup_lines') AS h3, max(high) FILTER (rate = 'repeat_words') AS h4
  FROM fences GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars // n_words BETWEEN low AND h1 AND 1000 * n_symbols // n_words <= h2
         AND 1000 * n_dup_lines // greatest(n_lines, 1) <= h3 AND 1000 * n_repeat_words // n_words <= h4 AS kept
FROM counts c LEFT JOIN wide f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
""",
}
