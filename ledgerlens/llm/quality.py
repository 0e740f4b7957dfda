"""Quality classifier from weak labels (operator 8).

Heuristic labellers vote on every document, for its quality and for its toxicity.
Expectation-maximisation over the counts of vote patterns estimates the accuracy
of every labeller; the posterior class of a pattern is the label that a hashed
linear scorer is trained on; the scorer judges every document by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerlens.llm.common import as_bytes, cut_lineage, release_memory, sample_hash, slices

#: Bounds of the samples of labelled rows of either class (for the word lists of
#: labellers) and of documents (for the scorer), by smallest hash of id and text;
#: rows that repeat both count once.
LABELLED_DOCS = 10_000
TRAIN_DOCS = 10_000
BUCKETS = 1 << 20
#: A posterior above which a document is rejected.
REJECT = 0.5
CACHE_WORDS = 300_000

# Votes.
YES, NO, ABSTAIN = 1, 0, 2

#: Labellers of bad style: name of a measure, and the share from which on it is
#: bad. Each finds one kind of bad text, so it votes YES or abstains; below the
#: first bound in all measures the labeller "plain" votes NO.
STYLE_RULES = (
    ("upper_case", 0.25, 0.6),
    ("marked_words", 0.2, 0.45),
    ("lone_symbols", 0.12, 0.3),
    ("repeated_lines", 0.4, 0.6),
    ("long_words", 0.1, 0.3),
    ("word_runs", 0.1, 0.3),
)
#: Labellers of toxicity: words, and beginnings of words, of the word lists. A
#: hit is a YES; without a hit in any the labeller "unlisted" votes NO.
LIST_RULES = ("words", "begin5", "begin4")

def _set(chars: bytes) -> np.ndarray:
    """Which byte values are in ``chars``; a blank always is."""
    out = np.zeros(256, bool)
    out[list(chars + b" ")] = True
    return out


_EDGE = _set(b".,;:!?\"'()[]{}")
_SYMBOL = _set(b"!#$%&*+-./:;<=>?@[]^_`{|}~,()\"'")
_MARK = _set(b"!#$%&*+-/<=>?@^_`|~")
_UPPER, _LOWER, _DIGIT = (_set(bytes(range(a, b))) & (np.arange(256) != 32) for a, b in ((65, 91), (97, 123), (48, 58)))
_FOLD = np.arange(256, dtype=np.uint64) + np.where(_UPPER, 32, 0).astype(np.uint64) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x632BE5AB)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.int64)


def analyse(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, flags and forms of words, all as arrays.

    Terms (three 32-bit hashes, -1: none): the word in lower case without
    punctuation around it, and its first five and four bytes. Flags: upper case,
    marked by symbols behind it, symbols alone, over 30 bytes. Form: a bucket of
    its case, whether it has digits, and up to four symbols behind it.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    pos, word = np.arange(len(c)), np.repeat(np.arange(len(words)), sizes + 1)

    def span(outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each word that is not ``outside``."""
        return np.minimum.reduceat(np.where(outside, len(c), pos), starts), np.maximum.reduceat(np.where(outside, -1, pos), starts)

    first, last = span(_EDGE[c])
    place = pos - first[word]
    inside = (place >= 0) & (pos <= last[word])
    power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _BASE))
    value = np.where(inside, _FOLD[c] * power[np.where(inside, place, 0)], np.uint64(0))
    terms = []
    for salt, length in ((1, 0), (5, 5), (4, 4)):
        h = _hash(np.add.reduceat(np.where(place < length, value, np.uint64(0)) if length else value, starts), salt)
        terms.append(np.where(last - first + 1 >= max(1, length), h, -1))
    first, last = span(_SYMBOL[c])
    core = last >= 0
    inside = (pos >= first[word]) & (pos <= last[word])
    upper, lower, digit = (np.logical_or.reduceat(t[c] & inside, starts) for t in (_UPPER, _LOWER, _DIGIT))
    shout = upper & ~lower & (last > first)
    case = np.where(~core, 0, np.where(shout, 1, np.where(_UPPER[c[np.minimum(first, len(c) - 1)]], 2, 3)))
    tail = np.where(core, span(_MARK[c])[1] + 1, starts)
    end = starts + sizes
    code = np.zeros(len(words), np.uint64)
    for j in range(4):
        code = code * np.uint64(257) + np.where(tail + j < end, c[np.minimum(tail + j, len(c) - 1)] + np.uint64(1), np.uint64(0))
    forms = _hash(code * np.uint64(8) + (case * 2 + digit).astype(np.uint64), 7) % BUCKETS
    return np.stack(terms, axis=1), np.stack([case == 1, core & (tail < end), ~core, sizes > 30], axis=1), forms


#: Scale of shares of word forms and of measures as features.
_SHARE = 10.0
_MEASURES = np.array([xxhash.xxh32_intdigest(b"m" + name.encode()) % BUCKETS for name, _, _ in STYLE_RULES], np.int64)


class Words:
    """The words a task has met, with what ``analyse`` says, by number, and which
    of their terms are in ``lists``. Arrays have room beyond the known words."""

    def __init__(self, lists: np.ndarray | None = None):
        self.lists = np.empty(0, np.int64) if lists is None else lists
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.terms, self.flags, self.forms = np.zeros((0, 3), np.int64), np.zeros((0, 4), bool), np.zeros(0, np.int64)
        self.listed = np.zeros((0, 3), bool)

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        tokens = [t.split() for t in texts]
        new = list(set(chain.from_iterable(tokens)).difference(self.known))
        if new:
            n, stop = len(self.known), len(self.known) + len(new)
            self.known.update(zip(new, range(n, stop), strict=True))
            terms, flags, forms = analyse(new)
            if stop > len(self.forms):  # twice the room, so that copies stay in proportion
                self.terms, self.flags, self.forms, self.listed = (
                    np.concatenate([x, np.zeros((stop, *x.shape[1:]), x.dtype)]) for x in (self.terms, self.flags, self.forms, self.listed))
            self.terms[n:stop], self.flags[n:stop], self.forms[n:stop] = terms, flags, forms
            self.listed[n:stop] = np.isin(terms, self.lists)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum())), sizes

    def measures(self, texts: list[bytes], numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The measures of ``STYLE_RULES``: texts by rules."""
        doc, n = np.repeat(np.arange(len(texts)), sizes), np.maximum(sizes, 1)

        def share(of: np.ndarray) -> np.ndarray:
            return np.bincount(doc[of], minlength=len(texts)) / n

        upper, marked, lone, long = (share(self.flags[numbers, k]) for k in range(4))
        runs = np.zeros(len(numbers), bool)
        runs[1:] = (numbers[1:] == numbers[:-1]) & (doc[1:] == doc[:-1])
        again = []
        for text in texts:
            filled = [x for x in map(bytes.strip, text.split(b"\n")) if x]
            again.append((len(filled) - len(set(filled))) / max(1, len(filled)))
        return np.stack([upper, marked, lone, np.array(again), long, share(runs)], axis=1)


@arrow_udf(T.LongType())
def copy_key(texts: pa.Array) -> pa.Array:
    """Least hash of a text's runs of five words: near copies mostly agree."""
    out = []
    for text in as_bytes(texts):
        words = text.lower().split()
        runs = [b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
        out.append(min(map(xxhash.xxh3_64_intdigest, runs)) - (1 << 63))
    return pa.array(out, pa.int64())


def word_lists(labelled: DataFrame, bound: int = LABELLED_DOCS) -> np.ndarray:
    """Terms over-represented in the toxic texts of a bounded sample of rows
    ``doc_id, text, toxic``, of near copies one: each in five or more of them
    and in two of a hundred, and at ten times the rate in the others. The bound
    holds for either class by itself, so rare toxic texts are all used; of rows
    that repeat an id and a text one counts."""
    classes = []
    for toxic in (0, 1):
        mine = labelled.where(F.col("toxic") == toxic)
        h, chosen = sample_hash(mine, bound, 5, "doc_id", "text")
        classes.append(mine.where(chosen).withColumn("h", h).dropDuplicates(["h"]))
    sample = classes[0].unionByName(classes[1]).select("text", "toxic", copy_key("text").alias("key"))
    # Of copies any may stand for the others; the least text makes it the same.
    sample = sample.groupBy("key", "toxic").agg(F.min("text").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches, "text"):
            numbers, sizes = words.number(as_bytes(part.column("text")))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rows = np.unique(np.concatenate([words.terms[numbers, k] << 24 | doc for k in range(3)])) if len(numbers) else np.empty(0, np.int64)
            rows = rows[rows >= 0]
            terms, place = np.unique(rows >> 24, return_inverse=True)
            bad = np.bincount(place, weights=toxic[rows & 0xFFFFFF], minlength=len(terms)).astype(np.int64)
            clean = np.bincount(place, minlength=len(terms)) - bad
            n = [int((toxic == k).sum()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, -1)), pa.array(np.append(clean, n[0])), pa.array(np.append(bad, n[1]))], names=["term", "clean", "bad"])

    # Term -1 counts texts. A term in five toxic texts is one of at most a fifth
    # of the sample's words and beginnings in toxic texts.
    counts = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "term long, clean long, bad long") \
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("term = -1 or bad >= 5").toPandas()
    total = counts[counts["term"] == -1]
    counts = counts[counts["term"] != -1]
    if not len(total) or not len(counts):
        return np.empty(0, np.int64)
    n_clean, n_bad = max(1, int(total["clean"].iloc[0])), max(1, int(total["bad"].iloc[0]))
    rate = (counts["clean"].to_numpy() + 0.5) / (n_clean + 1)
    bad = counts["bad"].to_numpy()
    strong = (bad >= 0.02 * n_bad) & (bad / n_bad >= 10 * rate)
    return np.sort(counts["term"].to_numpy()[strong].astype(np.int64))


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float, expected: float = 0.9, trusted: float = 0.98, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of the labellers' accuracies.

    ``patterns`` holds votes (rows by labellers), ``counts`` how many documents
    have each. Given the class, labellers vote or abstain independently, each
    at rates of its own; rates start from votes that are right with
    ``expected``. The last labeller, the given labels, stays at ``trusted``,
    which ties the classes to their meaning. Returns the posterior of class YES
    by pattern and, for each labeller, the share of its votes that agree with
    the posterior.
    """
    votes = np.stack([patterns == v for v in (NO, YES, ABSTAIN)], axis=2).astype(float)  # pattern, labeller, vote
    total = max(1.0, float(counts.sum()))
    said = (counts[:, None, None] * votes).sum(axis=0)[:, :ABSTAIN].sum(axis=1, keepdims=True) / total
    right = np.array([[expected, 1 - expected], [1 - expected, expected]])
    rate = np.stack([np.concatenate([said * right[c], 1 - said], axis=1) for c in (NO, YES)])
    rate = np.clip(rate, 1e-6, None)
    right = np.array([[trusted, 1 - trusted], [1 - trusted, trusted]])
    labels = np.clip(np.stack([np.append(said[-1] * right[c], 1 - said[-1]) for c in (NO, YES)]), 1e-6, None)
    rate[:, -1] = labels
    pi, post = prior, np.zeros(len(patterns))
    for _ in range(rounds):
        like = np.einsum("pjv,cjv->pc", votes, np.log(rate / rate.sum(axis=2, keepdims=True)))
        new = 1 / (1 + np.exp(-np.clip(like[:, YES] - like[:, NO] + np.log(pi / (1 - pi)), -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-7
        post = new
        if done:
            break
        rate = np.stack([np.einsum("p,pjv->jv", counts * p, votes) + 0.1 for p in (1 - post, post)])
        rate[:, -1] = labels
        pi = float(np.clip((counts * post).sum() / total, 1e-3, 0.5))
    agree = np.einsum("p,pj->j", counts * (1 - post), votes[:, :, NO]) + np.einsum("p,pj->j", counts * post, votes[:, :, YES])
    return post, agree / np.maximum(1e-9, np.einsum("p,pjv->j", counts, votes[:, :, :ABSTAIN]))


def train_linear(rows: list[tuple[np.ndarray, np.ndarray | None]], target: np.ndarray, epochs: int = 8, step: float = 0.3, shrink: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over hashed features, by proximal
    AdaGrad on soft targets in a fixed order. Every step shrinks the weights it
    touches towards zero, so words that tell nothing weigh nothing however many
    of them a long text holds. Features without values (None) count once."""
    w, g, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), 1e-3
    if not len(rows):
        return w, 0.0
    b = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(epochs):
        for a in range(0, len(order), 128):
            some = order[a:a + 128]
            at = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([np.ones(len(rows[i][0])) if rows[i][1] is None else rows[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            z = np.bincount(row, weights=w[at] * x, minlength=len(some)) + b
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[some]
            grad = np.bincount(at, weights=err[row] * x, minlength=BUCKETS) / len(some)
            hot = np.flatnonzero(grad)
            g[hot] += grad[hot] ** 2
            rate = step / np.sqrt(g[hot])
            moved = w[hot] - rate * grad[hot]
            w[hot] = np.sign(moved) * np.maximum(0.0, np.abs(moved) - rate * shrink)
            gb += err.mean() ** 2
            b -= step * err.mean() / np.sqrt(gb)
    return w, b


@dataclass(frozen=True)
class QualityModel:
    toxic: np.ndarray
    toxic_bias: float
    style: np.ndarray
    style_bias: float
    #: Estimated accuracies: the style labellers, "plain" and the labels; the
    #: list labellers, "unlisted" and the labels.
    style_accuracy: np.ndarray
    toxic_accuracy: np.ndarray


def _votes(lists: np.ndarray):
    low, high = (np.array([r[k] for r in STYLE_RULES]) for k in (1, 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lists)
        for part in slices(batches, "text"):
            texts = as_bytes(part.column("text"))
            numbers, sizes = words.number(texts)
            measures = words.measures(texts, numbers, sizes)
            doc, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
            hit = np.stack([np.bincount(doc[words.listed[numbers, k]], minlength=len(texts)) > 0 for k in range(len(LIST_RULES))], axis=1)
            row = np.concatenate([
                np.where(measures >= high, YES, ABSTAIN), np.where((measures <= low).all(axis=1), NO, ABSTAIN)[:, None],
                np.where(hit, YES, ABSTAIN), np.where(hit.any(axis=1) | (not len(lists)), ABSTAIN, NO)[:, None]], axis=1)
            terms, forms, shares = [], [], []
            for i, chosen in enumerate(part.column("sampled").to_pylist()):
                sampled = chosen is not None
                mine = np.unique(numbers[ends[i] - sizes[i]:ends[i]]) if sampled else numbers[:0]
                t = words.terms[mine]
                at, x = _style_features(words.forms[numbers[ends[i] - sizes[i]:ends[i]]], measures[i]) if sampled else (mine, mine.astype(float))
                terms.append(np.unique(t[t >= 0] % BUCKETS).tolist())
                forms.append(at.tolist())
                shares.append(x.tolist())
            votes = ["".join(map(str, r)) for r in row.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sampled"), pa.array(votes, pa.string()), pa.array(terms, pa.list_(pa.int32())), pa.array(forms, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "sampled", "votes", "terms", "forms", "shares"])
        del words
        release_memory()

    return run


def _style_features(forms: np.ndarray, measures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shares of word forms of a text, and its measures."""
    at, n = np.unique(forms, return_counts=True)
    return np.concatenate([at, _MEASURES]), _SHARE * np.concatenate([n / max(1, len(forms)), measures])


def fit(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """The scorer for ``docs``. ``labels`` (doc_id, quality, toxic) is one more
    labeller on the documents that it covers and abstains on the others; where
    it repeats an id, the lowest quality and the highest toxicity count."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    gold = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = gold.where("toxic in (0, 1)")
    # Ids first: at most labelled_docs of either class (two numbers each), so they
    # go to the texts, which stay where they are. Rows that repeat an id and a text
    # are one before they move.
    some = [marked.where(F.col("toxic") == k) for k in (0, 1)]
    some = [m.where(sample_hash(m, labelled_docs, 5, "doc_id")[1]).select("doc_id", "toxic") for m in some]
    chosen_texts = text.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    chosen_texts = chosen_texts.withColumn("same", F.xxhash64("doc_id", "text")).dropDuplicates(["same"]).drop("same")
    lists = word_lists(cut_lineage(chosen_texts), labelled_docs)
    h, chosen = sample_hash(text, train_docs, 9, "doc_id", "text")
    rows = text.select("doc_id", "text", F.when(chosen, h).alias("sampled"))
    voted = rows.mapInArrow(_votes(lists), "doc_id long, sampled long, votes string, terms array<int>, forms array<int>, shares array<double>")
    voted = cut_lineage(voted)
    said = lambda c, bad: F.when(F.col(c) == bad, str(YES)).when(F.col(c) == 1 - bad, str(NO)).otherwise(str(ABSTAIN))
    # One row a pattern: at most three to the number of labellers.
    patterns = voted.select("doc_id", "votes").join(gold, "doc_id", "left") \
        .groupBy("votes", said("quality", 0).alias("q"), said("toxic", 1).alias("t")).count().toPandas()
    n_style = len(STYLE_RULES) + 1
    posterior: list[dict[str, float]] = []
    accuracies = []
    for cut, mark, width, prior in ((slice(0, n_style), "q", n_style + 1, 0.1), (slice(n_style, None), "t", len(LIST_RULES) + 2, 0.1)):
        key = patterns["votes"].str[cut] + patterns[mark]
        sums = patterns["count"].groupby(key).sum()
        table = np.array([[int(c) for c in k] for k in sums.index], np.int64).reshape(len(sums), width)
        post, accuracy = estimate(table, sums.to_numpy(float), prior)
        posterior.append(dict(zip(sums.index, post, strict=True)))
        accuracies.append(accuracy)
    train = voted.where("sampled is not null").dropDuplicates(["sampled"]).join(gold, "doc_id", "left").select("doc_id", "votes", said("quality", 0).alias("q"), said("toxic", 1).alias("t"), "terms", "forms", "shares") \
        .toArrow().sort_by([("doc_id", "ascending"), ("votes", "ascending")])
    votes = train.column("votes").to_pylist()
    bad_style = np.array([posterior[0][v[:n_style] + q] for v, q in zip(votes, train.column("q").to_pylist(), strict=True)])
    bad_words = np.array([posterior[1][v[n_style:] + t] for v, t in zip(votes, train.column("t").to_pylist(), strict=True)])
    # Views of the collected columns: the driver holds a sampled feature once.
    def as_rows(name: str) -> list[np.ndarray]:
        flat = train.column(name).combine_chunks()
        return np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1]) if len(flat) else []

    terms = [(t, None) for t in as_rows("terms")]
    forms = list(zip(as_rows("forms"), as_rows("shares"), strict=True))
    del train
    toxic, toxic_bias = train_linear(terms, bad_words)
    shapes, style_bias = train_linear(forms, bad_style)
    del terms, forms
    release_memory()
    return QualityModel(toxic, toxic_bias, shapes, style_bias, *accuracies)


def scorer(docs: DataFrame, model: QualityModel):
    """Column function: ``(quality, toxicity)`` of a text, both from 0 to 1; a
    null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two times BUCKETS numbers

    @arrow_udf("struct<quality:double,toxicity:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        words = Words()
        for column in batches:
            quality, toxicity = [], []
            rows = pa.RecordBatch.from_arrays([column], names=["text"])
            for part in slices([rows], "text"):
                texts = as_bytes(part.column("text"))
                numbers, sizes = words.number(texts)
                doc = np.repeat(np.arange(len(texts)), sizes)
                formed = np.bincount(doc, weights=m.style[words.forms[numbers]], minlength=len(texts)) / np.maximum(sizes, 1)
                bad = m.style_bias + _SHARE * (formed + words.measures(texts, numbers, sizes) @ m.style[_MEASURES])
                # Most words weigh nothing; each bucket counts once a text.
                here = words.terms[numbers]
                weigh = (m.toxic[here % BUCKETS] != 0) & (here >= 0)
                rows = np.unique(np.concatenate([(here[:, k] % BUCKETS << 24 | doc)[weigh[:, k]] for k in range(3)]))
                toxic = np.bincount(rows & 0xFFFFFF, weights=m.toxic[rows >> 24], minlength=len(texts))
                quality.append(1 / (1 + np.exp(np.clip(bad, -30, 30))))
                toxicity.append(1 / (1 + np.exp(-np.clip(m.toxic_bias + toxic, -30, 30))))
            join = lambda xs: pa.array(np.concatenate(xs) if xs else np.empty(0))
            yield pa.StructArray.from_arrays([join(quality), join(toxicity)], names=["quality", "toxicity"])
        del words
        release_memory()

    return score


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality, toxicity, keep`` of every row of ``docs``.

    Rows are judged by their text alone, so null ids and repeated rows are
    judged like others; a null or empty text has the forms of an empty one.
    Without labels the toxicity labellers abstain. An empty table gives an
    empty result.
    """
    score = scorer(docs, fit(docs, labels))
    rows = docs.select("doc_id", score(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "s.quality", "s.toxicity", ((F.col("s.quality") >= 1 - REJECT) & (F.col("s.toxicity") <= REJECT)).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the scorer keeps."""
    s = scorer(docs, fit(docs.select("doc_id", "text"), labels))(F.col("text").cast("string"))
    return docs.where((s.getField("quality") >= 1 - REJECT) & (s.getField("toxicity") <= REJECT))
