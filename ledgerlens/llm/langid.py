"""Language identification (operator 10).

A word's script narrows the languages that it may belong to; each candidate
scores the word by its character trigrams; Viterbi over the words of a text with
a penalty for every switch labels spans of mixed-language text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import crc_mod, sample_hash, slices

#: Bound of the labelled sample that the model is fitted on, by smallest hash of
#: the document's id, text and language.
TRAIN_DOCS = 12_000
BUCKETS = 1 << 16
SWITCH_PENALTY = 6.0
SMOOTHING = 0.05
#: A language is a candidate for a script that this share of its letters is in.
MIN_SCRIPT_SHARE = 0.002
UNKNOWN = "und"
#: Score of a word in a language that is no candidate for its script.
NEVER = -1e9
CACHE_WORDS = 200_000

# Scripts by ranges of code points.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x77F),)),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x9FFF), (0x20000, 0x2FA1F))),
    ("hangul", ((0xAC00, 0xD7AF),)),
)
OTHER_SCRIPT = len(SCRIPTS)
_WORD = re.compile(r"[^\W\d_]+")


_EDGES = np.array(sorted({x for _, ranges in SCRIPTS for a, b in ranges for x in (a, b + 1)}), np.uint32)
_SCRIPT_AT = np.full(len(_EDGES) + 1, OTHER_SCRIPT)
for _i, (_, _ranges) in enumerate(SCRIPTS):
    for _a, _b in _ranges:
        _SCRIPT_AT[np.searchsorted(_EDGES, _a, side="right"):np.searchsorted(_EDGES, _b, side="right") + 1] = _i


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: the buckets of all trigrams between boundary marks, where each
    word's begin, and the script of each word's first letter."""
    chars = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes + 2) - (sizes + 2)
    c = chars.astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77C2B2AE63)) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    buckets = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    inside = np.ones(len(chars), bool)
    inside[first + sizes], inside[first + sizes + 1] = False, False  # would cross a boundary
    starts = np.cumsum(sizes) - sizes  # as many trigrams as letters
    return buckets[inside[:-2]], starts, _SCRIPT_AT[np.searchsorted(_EDGES, chars[first + 1], side="right")]


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: log P(trigram bucket | language), languages by buckets.
    log_p: np.ndarray
    #: Whether a language is a candidate for a script.
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words by languages. Words are scored by the candidates for
        their script alone (by all languages, where a script has none); the others
        are out of the question: no text is long enough to make one worth it."""
        at, starts, scripts = trigrams(words)
        sizes = np.diff(np.r_[starts, len(at)])
        out = np.full((len(words), len(self.langs)), NEVER, np.float32)
        for script in np.unique(scripts):
            mine = np.flatnonzero(scripts == script)
            candidates = np.flatnonzero(self.allowed[:, script])
            candidates = candidates if len(candidates) else np.arange(len(self.langs))
            n = sizes[mine]
            first = np.cumsum(n) - n
            grams = at[np.repeat(starts[mine] - first, n) + np.arange(int(n.sum()))]
            out[mine[:, None], candidates] = np.add.reduceat(self.log_p[candidates][:, grams].T, first, axis=0)
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """The model of the texts and non-null languages of ``docs``, from a sample
    of at most ``train_docs`` rows (smallest hash of doc_id and text, of rows
    that repeat both one). Trigram counts are summed by Spark; the driver gets at
    most languages x buckets of them."""
    sample = docs.where("text is not null and lang is not null").select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # Hashes first: only the sample's texts are moved.
    h, chosen = sample_hash(sample, train_docs, 11, "d", "text", "lang")
    sample = sample.where(chosen).withColumn("h", h).dropDuplicates(["h"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams: dict[str, np.ndarray] = {}
            held: dict[str, list[str]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                held.setdefault(lang, []).extend(_WORD.findall(text.lower()))
            for lang, words in held.items():
                if words:
                    at, _, scripts = trigrams(words)
                    grams[lang] = np.bincount(np.concatenate([at, BUCKETS + scripts]), minlength=BUCKETS + OTHER_SCRIPT + 1)
            for lang, row in grams.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts["lang"].unique()))
    table = np.zeros((len(langs), BUCKETS + OTHER_SCRIPT + 1))
    if langs:
        table[[langs.index(x) for x in counts["lang"]], counts["bucket"]] = counts["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    log_p = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return LanguageModel(langs, log_p.astype(np.float32), scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= MIN_SCRIPT_SHARE)


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """Best language of every word of every text; ``scores`` has an array of
    words by languages for each text. All texts advance together, the longest
    first, so a step is one operation on the texts that still have words."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return [np.empty(0, np.int64) for _ in scores]
    n_lang = next(s.shape[1] for s in scores if len(s))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = np.concatenate([scores[i] for i in order if len(scores[i])])
    back = np.zeros((len(flat), n_lang), np.uint8 if n_lang < 256 else np.int32)
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
    own = np.arange(n_lang)
    best = np.zeros((len(lengths), n_lang))
    best[:active[0]] = flat[starts[:active[0]]]
    for t in range(1, longest):
        k = active[t]
        v = best[:k]
        top = v.argmax(axis=1)
        high = v[np.arange(k), top] - penalty
        stay = v >= high[:, None]
        rows = starts[:k] + t
        back[rows] = np.where(stay, own, top[:, None])
        best[:k] = np.where(stay, v, high[:, None]) + flat[rows]
    label = np.zeros(len(flat), np.int64)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = starts[:k] + t
        label[rows] = now[:k]
        now[:k] = back[rows, now[:k]] if t else now[:k]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    for place, i in enumerate(order):
        out[i] = label[starts[place]:starts[place] + lengths[place]]
    return out




def label_spans(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for each row of ``docs``.

    spans: ``(start, end, lang)`` in words that hold letters, end exclusive.
    lang_pred has the most letters (ties: the first in code-point order); score
    is its share of them. A null text, a text without letters, or a model that
    has learned no language: 'und', score 0, no spans. Rows are judged one by
    one by their text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        known: dict[str, int] = {}
        table: list[np.ndarray] = []
        sizes: list[int] = []
        for part in slices(batches, "text"):
            if len(known) > CACHE_WORDS:
                known, table, sizes = {}, [], []
            found = [_WORD.findall(text.lower()) if text and m.langs else [] for text in part.column("text").to_pylist()]
            new = list(set(chain.from_iterable(found)).difference(known))
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                table = [np.concatenate([*table, m.word_scores(new)])]
                sizes += map(len, new)
            numbers = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in found]
            scores = table[0] if table else np.zeros((0, max(1, len(m.langs))))
            letters = np.array(sizes, np.int64)
            langs, shares, spans = [], [], []
            for at, lab in zip(numbers, viterbi([scores[x] for x in numbers], penalty), strict=True):
                if not len(at):
                    langs.append(UNKNOWN)
                    shares.append(0.0)
                    spans.append([])
                    continue
                held = np.bincount(lab, weights=letters[at], minlength=len(m.langs))
                langs.append(m.langs[int(held.argmax())])
                shares.append(float(held.max() / held.sum()))
                cut = [0, *(np.flatnonzero(np.diff(lab)) + 1).tolist(), len(lab)]
                spans.append([{"start": a, "end": b, "lang": m.langs[int(lab[a])]} for a, b in zip(cut, cut[1:], strict=False)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Fit on the rows whose crc32 of the id modulo 4 is not 2 and label all
    rows; adds ``held_out`` (that remainder is 2; false for a null id)."""
    model = fit(docs.select("doc_id", "text", "lang").where(crc_mod("doc_id", 4) != 2), train_docs)
    found = label_spans(docs, model, penalty)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
