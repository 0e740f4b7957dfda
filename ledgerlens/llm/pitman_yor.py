"""Language-model scoring with a hierarchical Pitman-Yor model (operator 3).

The model predicts a token from the word before it. Every word (and the start of
a text) has a context restaurant; the root restaurant is the common parent of
all context restaurants, its base is uniform over the known words and one
unknown word. The customers of the root are the tables of its children. A Gibbs
sweep
takes all customers of every dish from their tables and seats them anew by the
Chinese-restaurant rule; probabilities are averaged over sweeps after a burn-in.

How the work is spread. Tokens travel as 64-bit hashes in compressed blocks, one
for each slice of documents and part of the vocabulary; a part holds all
occurrences of its words, so its dishes are seated in one task. A frequent word,
one that holds an eighth of a part or more, is dealt by word and context instead
and its root dish is seated by the driver: there are at most eight such words a
part. Contexts are known by their 64-bit hashes. After each sweep every part's
tables by context are summed over the parts, bucket by bucket of the hashes, and
the totals go back to the parts that hold the context; the driver gets sums over
the root and of the frequent words alone. Seeds depend on part and sweep alone,
so a part's seating can be replayed anywhere, which the scoring pass does
instead of storing tables.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, checkpoint_dealt, crc_mod, cut_lineage, drop_unused, release_memory, slices

#: A word with this share of a part's training tokens is dealt by context.
DEAL_SHARE = 1 / 8
STRENGTH = 1.0
SWEEPS, BURN_IN = 4, 2
#: Largest dish whose number of tables is drawn at once; of larger ones all
#: customers move, in so many groups.
DIRECT, VISITS = 2048, 8
#: Tokens of a slice of documents, and of a part of the vocabulary.
SLICE_TOKENS, PART_TOKENS = 2_000_000, 4_000_000
MIN_PARTS = 64
#: Most buckets of contexts.
BUCKETS = 1024

_END = xxhash.xxh3_64_intdigest(b"end of text", 1)  # no word holds a blank
_START = xxhash.xxh3_64_intdigest(b"start of text", 1)
_CODEC = "zstd"


def _pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True))


def _planes(sorted_keys: np.ndarray) -> np.ndarray:
    """Gaps of ascending keys byte by byte, so that the high zeros compress."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unplanes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def _apart(x: np.ndarray) -> np.ndarray:
    """Integers byte by byte: each byte's values compress by themselves."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _together(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}")[:, 0]


#: Contexts are known by the high 48 bits of their hash: of 100 million words
#: some 20 pairs share a restaurant.
_CONTEXT = np.uint64(0xFFFF_FFFF_FFFF_0000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def unigrams(texts: DataFrame) -> DataFrame:
    """``h, n``: training tokens by hash, the end token included. Counts are
    summed in each slice before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        docs = 0

        def flush() -> pa.RecordBatch:
            h = np.append(word_hashes(list(held)), np.uint64(_END)).view(np.int64)
            n = np.fromiter(chain(held.values(), [docs]), np.int64, len(held) + 1)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

        for part in slices(batches, "text"):
            for text in as_bytes(part.column("text")):
                held.update(text.lower().split())
                docs += 1
            if len(held) > 400_000:
                yield flush()
                held, docs = Counter(), 0
        if docs:
            yield flush()
        held.clear()
        release_memory()

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What all tasks know: totals and the frequent words."""

    tokens: int
    types: int
    #: Ascending hashes of the frequent words and their counts.
    frequent: np.ndarray
    counts: np.ndarray
    parts: int

    def number(self, h: np.ndarray) -> np.ndarray:
        """Place + 1 among the frequent words, 0 for other words."""
        out = np.zeros(len(h), np.int32)
        if len(self.frequent):
            seen = np.zeros(1 << 18, bool)
            seen[self.frequent >> np.uint64(46)] = True
            at = np.flatnonzero(seen[h >> np.uint64(46)])
            place = np.minimum(np.searchsorted(self.frequent, h[at]), len(self.frequent) - 1)
            ok = self.frequent[place] == h[at]
            out[at[ok]] = place[ok] + 1
        return out

    @property
    def buckets(self) -> int:
        return min(self.parts, BUCKETS)


def vocabulary(texts: DataFrame, deal_share: float = DEAL_SHARE) -> Vocabulary:
    counts = cut_lineage(unigrams(texts))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens = total.n or 0
    parts = MIN_PARTS
    while parts * PART_TOKENS < tokens:
        parts *= 2
    rows = counts.where(F.col("n") >= max(2, int(np.ceil(tokens / parts * deal_share)))).toPandas()  # at most parts / deal_share
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(tokens, total.v, h[order], rows["n"].to_numpy(np.int64)[order], parts)


def occurrences(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``part, slice, data``: blocks of tokens by part of the vocabulary, and one
    block a slice (part below 0) with its documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # at most 1 / DEAL_SHARE words a part

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        bits = np.uint64(64 - (v.parts.bit_length() - 1))
        seq, task = 0, None
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[2])  # training documents first
            lengths = np.array([len(x[3]) for x in held])
            ends = np.cumsum(lengths + 1) - 1
            h = np.empty(int(lengths.sum()) + len(held), np.uint64)
            inner = np.ones(len(h), bool)
            inner[ends] = False
            h[inner] = np.concatenate([x[3] for x in held])
            h[ends] = _END
            own = v.number(h)
            ctx = np.empty(len(h), np.uint64)
            ctx[1:] = h[:-1]
            ctx[np.append(0, ends[:-1] + 1)] = _START
            ctx &= _CONTEXT
            contexts, ctx_place = np.unique(ctx, return_inverse=True)
            doc = np.repeat(np.arange(len(held), dtype=np.uint64), lengths + 1)
            key = np.where(own > 0, _mix(h + ctx * np.uint64(0x9E3779B97F4A7C15)), h)
            words, first, number = np.unique(key, return_index=True, return_inverse=True)
            # Below 2^64: slices hold few words or one document.
            n_ctx, n_docs = np.uint64(len(contexts)), np.uint64(len(held))
            rows, counts = np.unique((number.astype(np.uint64) * n_ctx + ctx_place.astype(np.uint64)) * n_docs + doc, return_counts=True)
            pair, row_doc = np.divmod(rows, n_docs)
            row_word, row_ctx = np.divmod(pair, n_ctx)
            per_word = np.bincount(row_word.astype(np.int64), minlength=len(words))
            word_cut = np.searchsorted(words >> bits, np.arange(v.parts + 1, dtype=np.uint64))
            row_cut = np.append(0, np.cumsum(per_word))[word_cut]
            n_train = sum(not x[2] for x in held)
            name = (task << 32) + seq
            parts, data = [-1 - (task + seq) % v.parts], [_pack(
                np.array([-1 if x[0] is None else x[0] for x in held], np.int64), np.array([x[0] is None for x in held]), np.array([x[1] for x in held]),
                lengths + 1)]
            for p in range(v.parts):
                a, b = word_cut[p], word_cut[p + 1]
                if a < b:
                    some = slice(row_cut[p], row_cut[p + 1])
                    here, at = np.unique(row_ctx[some], return_inverse=True)
                    n = counts[some]
                    parts.append(p)
                    data.append(_pack(
                        np.array([len(held), n_train]), _planes(words[a:b]), own[first[a:b]], per_word[a:b].astype(np.uint32 if per_word[a:b].max() > 65535 else np.uint16),
                        _planes(contexts[here.astype(np.int64)]), _apart(at.astype(np.uint16 if len(here) < 65_536 else np.uint32)), _apart(row_doc[some].astype(np.uint16)), n.astype(np.uint8 if n.max() < 256 else np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array(data, pa.binary())], names=["part", "slice", "data"])

        for some in slices(batches, "text"):
            task = some.column("task")[0].as_py()
            for d, out, text in zip(some.column("doc_id").to_pylist(), some.column("held_out").to_pylist(), as_bytes(some.column("text")), strict=True):
                words = text.lower().split()
                if held and len(words) >= SLICE_TOKENS:
                    yield flush()
                    seq, size = seq + 1, 0
                    held.clear()
                # Third: not learned from. A null id is in neither remainder.
                held.append((d, bool(out), out is None or out, word_hashes(words)))
                size += len(words) + 1
                if size >= SLICE_TOKENS or len(held) >= 65_535:
                    yield flush()
                    seq, size = seq + 1, 0
                    held.clear()
        if held:
            yield flush()
        held.clear()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", 7) == 2).alias("held_out")) \
        .withColumn("task", F.spark_partition_id().cast("long"))
    return rows.mapInArrow(run, "part int, slice long, data binary")


#: By discount: row c - 1 holds the logarithms of the generalised Stirling
#: numbers of c customers at 1 to c tables, for c up to what was asked so far.
_STIRLING: dict[float, list[np.ndarray]] = {}


def _stirling(c: int, discount: float) -> np.ndarray:
    if discount not in _STIRLING and len(_STIRLING) >= 2:  # root and contexts
        _STIRLING.clear()
    rows = _STIRLING.setdefault(discount, [np.zeros(1)])
    while len(rows) < c:
        n, old = len(rows), rows[-1]
        stay = np.append(old + np.log(n - discount * np.arange(1, n + 1)), -np.inf)
        rows.append(np.logaddexp(stay, np.append(-np.inf, old)))
    return rows[c - 1]


def table_numbers(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers, 1 to DIRECT, drawn anew
    from their exact distribution: weight to the power of t times the Stirling
    number of c and t."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    values, first = np.unique(c[order], return_index=True)
    log_w = np.log(weight)
    for n, rows in zip(values.tolist(), np.split(order, first)[1:], strict=True):
        if n < 2:
            continue
        known, t = _stirling(n, discount), np.arange(1, n + 1)
        step = max(1, 1_000_000 // n)
        for a in range(0, len(rows), step):
            some = rows[a:a + step]
            p = log_w[some, None] * t + known
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (p[:, :-1] <= (rng.random(len(some)) * p[:, -1])[:, None]).sum(axis=1)
    return out


def _openings(c: int, t: int, m: int, weight: float, discount: float, rng: np.random.Generator) -> list[int]:
    """Which of ``m`` customers who come one by one to a dish of ``c`` at ``t``
    tables open a table. The wait for the next one is beta-geometric."""
    out, i = [], 0
    while True:
        chance = rng.beta(weight, c + i - discount * t)
        wait = math.log(1.0 - rng.random()) / math.log1p(-chance) if 0 < chance < 1 else 0.0 if chance else math.inf
        if wait >= m - i:
            return out
        i += int(wait)
        out.append(i)
        i, t = i + 1, t + 1


def _seat(sizes: np.ndarray, opened: list[int], m: int, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes after ``m`` customers of whom those in ``opened`` open tables. From
    the last new table back: who came after its opening and sits at it or at an
    older one is dealt by an urn."""
    c, t, left, stop = int(sizes.sum()), len(sizes) + len(opened), 0, m
    new = []
    for o in reversed(opened):
        left += stop - o - 1
        t, stop = t - 1, o
        got = int(rng.binomial(left, rng.beta(1 - discount, c + o - discount * t)))
        new.append(1 + got)
        left -= got
    share = rng.gamma(sizes - discount)
    return np.append(sizes + rng.multinomial(left + stop, share / share.sum()), np.array(new[::-1], np.int64))


def _log_norm(c: int, t: int, m: int, opened: list[int], weight: float, discount: float) -> float:
    """Logarithm of the product of all that ``m`` customers choose from."""
    total, low = 0.0, 0
    for high in [*(o + 1 for o in opened), m]:
        at = c - discount * t + weight
        total += math.lgamma(at + high) - math.lgamma(at + low)
        low, t = high, t + 1
    return total


def visit(sizes: np.ndarray, weight: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes after every customer of a dish has left and come back once, in
    VISITS groups. A group's new seats are accepted or refused (Metropolis and
    Hastings), which makes up for weights that hang on the order of coming."""
    todo = sizes.copy()
    for left in range(VISITS, 0, -1):
        m = -(-int(todo.sum()) // left)
        out = rng.multivariate_hypergeometric(todo, m, method="marginals")
        todo, rest = todo - out, sizes - out
        stay = rest > 0
        base = rest[stay]
        c, t = int(base.sum()), len(base)
        gone = out[~stay]
        old: list[int] = []
        if len(gone):  # when those who open the emptied tables again would come
            at = rng.choice(m, int(gone.sum()), replace=False)
            old = sorted(np.minimum.reduceat(at, np.cumsum(gone) - gone).tolist())
        new = _openings(c, t, m, weight, discount, rng)
        gain = _log_norm(c, t, m, new, weight, discount) - _log_norm(c, t, m, old, weight, discount)
        if math.log(1.0 - rng.random()) <= gain:
            sizes = _seat(base, new, m, discount, rng)
            todo = np.append(todo[stay], np.zeros(len(new), np.int64))
    return sizes


def _start(c: int, weight: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes to begin with: the restaurant rule makes them a Poisson number of
    independent sizes whose sum is ``c``; here the last table takes the rest."""
    low, high = -745.0, 0.0  # logarithm of 1 - z, where the expected sum is c
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if math.log(weight) + math.log1p(-math.exp(mid)) + (discount - 1) * mid < math.log(c) else (mid, high)
    z = -math.expm1(low)
    n = int(rng.poisson(min(-weight / discount * math.expm1(discount * low), c)))
    sizes = np.empty(0, np.int64)
    while len(sizes) < n:
        some = rng.geometric(np.maximum(rng.beta(discount, 1 - discount, 2 * n + 16), 1e-15))
        sizes = np.append(sizes, some[rng.random(len(some)) < z ** (some - 1.0)])
    sizes = sizes[:n]
    sizes = sizes[np.cumsum(np.minimum(sizes, c)) < c]
    return np.append(sizes, c - sizes.sum())


class Tables:
    """Tables of many dishes, each with ``c`` customers at ``t`` tables.

    Of a dish of at most DIRECT customers a sweep draws the number of tables from
    its exact distribution, whatever it was; sizes do not matter and are drawn
    when they are asked for. Sizes of larger dishes are kept and every customer
    moves. Tables are opened as needed.
    """

    def __init__(self, c: np.ndarray, weight: np.ndarray, room: np.ndarray, rng: np.random.Generator):
        """First seating, which sweeps replace: about as many tables, ``room`` at
        most, as customers open who come one by one and find ``weight`` for a new
        table; all but the first hold one."""
        self.c = c.astype(np.int64)
        extra = rng.poisson(weight * np.log((np.maximum(self.c, 1) + weight) / (1 + weight)))
        self.t = np.where(self.c > 0, 1 + np.minimum(extra, np.maximum(np.minimum(room, self.c) - 1, 0)), 0)
        self.discount: float | None = None
        self.held = {r: self._first(r) for r in np.flatnonzero(self.c > DIRECT).tolist()}

    def _first(self, r: int) -> np.ndarray:
        return np.append(self.c[r] - self.t[r] + 1, np.ones(int(self.t[r]) - 1, np.int64))

    def sizes_of(self, r: int, rng: np.random.Generator) -> np.ndarray:
        """Sizes of a dish's tables, drawn for their number if not kept."""
        if r in self.held:
            return self.held[r]
        c, t = int(self.c[r]), int(self.t[r])
        if not c or self.discount is None:
            return self._first(r) if c else np.empty(0, np.int64)
        opened = []
        for n in range(c, 1, -1):  # whether the n-th customer opened a table
            if t > 1 and (t == n or rng.random() < math.exp(_stirling(n - 1, self.discount)[t - 2] - _stirling(n, self.discount)[t - 1])):
                opened.append(n - 2)
                t -= 1
        return _seat(np.ones(1, np.int64), opened[::-1], c - 1, self.discount, rng)

    @property
    def start(self) -> np.ndarray:
        """Where the tables of each dish begin in ``sizes``."""
        return np.cumsum(self.t) - self.t

    @property
    def sizes(self) -> np.ndarray:
        rng = np.random.default_rng(17)
        return np.concatenate([np.empty(0, np.int64), *(self.sizes_of(r, rng) for r in range(len(self.c)))])

    def sweep(self, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """All customers of each dish leave and sit down again: at a table by its
        size less the discount, at a new one by ``weight``."""
        if self.discount is None:
            self.held = {r: _start(int(self.c[r]), float(weight[r]), discount, rng) for r in self.held}
        self.discount = discount
        rows = np.flatnonzero((self.c > 1) & (self.c <= DIRECT))
        self.t[rows] = table_numbers(self.c[rows], weight[rows], discount, rng)
        for r, sizes in self.held.items():
            self.held[r] = visit(sizes, float(weight[r]), discount, rng)
            self.t[r] = len(self.held[r])

    def resize(self, c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Customers come or leave until dishes have ``c`` of them."""
        c = c.astype(np.int64)
        for r in np.flatnonzero((c != self.c) & (c > DIRECT)).tolist():
            sizes, more = self.sizes_of(r, rng), int(c[r] - self.c[r])
            if more < 0:
                sizes = sizes - rng.multivariate_hypergeometric(sizes, -more, method="marginals")
                sizes = sizes[sizes > 0]
            else:
                if not len(sizes):
                    sizes, more = np.ones(1, np.int64), more - 1
                sizes = _seat(sizes, _openings(int(sizes.sum()), len(sizes), more, float(weight[r]), discount, rng), more, discount, rng)
            self.held[r], self.t[r] = sizes, len(sizes)
        for r in [r for r in self.held if c[r] <= DIRECT]:
            del self.held[r]
        rows = np.flatnonzero((c != self.c) & (c <= DIRECT))
        self.t[rows] = np.where(c[rows] > 0, table_numbers(c[rows], weight[rows], discount, rng), 0)
        self.c, self.discount = c.copy(), discount


@dataclass(frozen=True)
class State:
    """What a sweep needs from all parts together: tables of the contexts (in a
    part, by its contexts), customers and tables of the root, root probabilities
    of frequent words."""

    context_tables: np.ndarray
    customers: int
    tables: int
    frequent_p: np.ndarray


@dataclass(frozen=True)
class Setting:
    types: int
    context_customers: np.ndarray
    discounts: tuple[float, float]  # root, contexts

    def root_weight(self, tables: int) -> float:
        """Weight of a new table in the root: strength and discount over the
        uniform base."""
        return (STRENGTH + self.discounts[0] * tables) / (self.types + 1)

    def root_p(self, c: np.ndarray, t: np.ndarray, state: State) -> np.ndarray:
        return (c - self.discounts[0] * t + self.root_weight(state.tables)) / (STRENGTH + state.customers)


class Part:
    """One part of the vocabulary: words and the types (word, context) in it.

    ``number`` tells a frequent word (its place + 1) from others (0). ``ctx`` is
    the place + 1 among the part's contexts; 0 goes straight to the root.
    """

    def __init__(self, number: np.ndarray, word: np.ndarray, ctx: np.ndarray, count: np.ndarray):
        self.number, self.word, self.ctx, self.count = number, word, ctx, count
        rare = number[word] == 0
        n = len(number)
        self.total = np.bincount(word[rare], weights=count[rare], minlength=n).astype(np.int64)
        #: Root customers that stay: the root's own tokens and lone customers.
        own = np.where(ctx == 0, count, np.where(count == 1, 1, 0))
        self.fixed = np.bincount(word, weights=own, minlength=n).astype(np.int64)
        self.seated = np.flatnonzero((ctx > 0) & (count > 1))
        self.rare = number == 0

    def sweeps(self, name: int, setting: Setting, states: list[State]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables of the types, customers and tables of the root dishes after
        each of the sweeps whose preceding states are given."""
        d0, d1 = setting.discounts
        rows, c = self.seated, self.count[self.seated]
        word, ctx = self.word[rows], self.ctx[rows]
        table_of = np.where((self.ctx > 0) & (self.count > 0), 1, 0)
        child = root = None
        for s, state in enumerate(states):
            rng = np.random.default_rng([11, name, s])
            if child is None:
                customers = self.fixed + np.bincount(word, minlength=len(self.number))
                p = setting.root_p(customers, np.minimum(customers, 1), state)
            else:
                p = setting.root_p(root.c, root.t, state)
            p = np.where(self.rare, p, state.frequent_p[np.maximum(self.number - 1, 0)] if len(state.frequent_p) else p)
            weight = (STRENGTH + d1 * state.context_tables[ctx]) * p[word]
            if child is None:
                child = Tables(c, weight, c, rng)
            child.sweep(weight, d1, rng)
            table_of[rows] = child.t
            customers = self.fixed + np.bincount(word, weights=child.t, minlength=len(self.number)).astype(np.int64)
            base = np.full(len(self.number), setting.root_weight(state.tables))
            mine = np.where(self.rare, customers, 0)
            if root is None:
                root = Tables(mine, base, mine, rng)
            else:
                root.resize(mine, base, d0, rng)
            root.sweep(base, d0, rng)
            yield table_of, customers, root.t


def _load(blocks: list[tuple[int, bytes]]) -> tuple[Part, np.ndarray, dict]:
    """The part that blocks (of one part, by slice) hold, its contexts' hashes in
    order, and its entries: the type, document and count of each."""
    got = [(name, *_unpack(data)) for name, data in sorted(blocks)]
    got = [(*x[:6], _together(x[6]), _together(x[7]), *x[8:]) for x in got]
    keys = [_unplanes(x[2]) for x in got]
    words, place = np.unique(np.concatenate(keys), return_inverse=True)
    number = np.zeros(len(words), np.int32)
    number[place] = np.concatenate([x[3] for x in got])
    word = np.repeat(place, np.concatenate([x[4] for x in got]).astype(np.int64))
    named = [_unplanes(x[5]) for x in got]
    contexts, place = np.unique(np.concatenate(named), return_inverse=True)
    first = np.cumsum([0, *map(len, named)])
    ctx = np.concatenate([place[a + x[6].astype(np.int64)] for a, x in zip(first, got, strict=False)])
    n = np.concatenate([x[8].astype(np.int64) for x in got])
    doc = np.concatenate([x[7] for x in got])
    sizes = [len(x[7]) for x in got]
    train = doc < np.repeat([int(x[1][1]) for x in got], sizes)
    types, kind = np.unique(word.astype(np.int64) << 32 | ctx.astype(np.int64), return_inverse=True)
    count = np.bincount(kind, weights=n * train, minlength=len(types)).astype(np.int64)
    part = Part(number, types >> 32, (types & 0xFFFFFFFF) + 1, count)
    return part, contexts, {"slices": [x[0] for x in got], "docs": [int(x[1][0]) for x in got], "sizes": sizes, "kind": kind, "doc": doc, "n": n}


def _by_part(batches: Iterable[pa.RecordBatch], key: str = "part", name: str = "slice") -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Blocks of each part (or ``key``) from batches in order of it."""
    part, held = None, []
    for batch in batches:
        for p, s, data in zip(batch.column(key).to_pylist(), batch.column(name).to_pylist(), batch.column("data").to_pylist(), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((s, data))
    if held:
        yield part, held


#: Keys of sums that parts return, beside the root customers of frequent words
#: by their places.
ROOT_CUSTOMERS, ROOT_TABLES, ONES, TWOS, ROOT_ONES, ROOT_TWOS = range(-6, 0)


def _sums_batch(sums: dict[int, int], part: int, data: bytes | None, by_bucket: list[bytes]) -> pa.Table:
    """Rows of a part: its sums by key, blocks of its contexts by bucket, data."""
    keys = [k for k, v in sums.items() if v]
    n, m = len(keys), len(by_bucket)
    return pa.Table.from_arrays(
        [pa.array([part] * (n + m + 1), pa.int32()), pa.array([*keys] + [None] * (m + 1), pa.int32()), pa.array([int(sums[k]) for k in keys] + [None] * (m + 1), pa.int64()),
         pa.array([None] * n + [*range(m), None], pa.int32()), pa.array([None] * n + by_bucket + [data], pa.binary())],
        names=["part", "key", "value", "bucket", "data"])


_SUMS = "part int, key int, value long, bucket int, data binary"


def _by_bucket(buckets: int, contexts: np.ndarray, *values: np.ndarray) -> list[bytes]:
    """Blocks of a part's contexts and their values by the hashes' high bits."""
    bits = 64 - (buckets.bit_length() - 1)
    cut = np.append(np.searchsorted(contexts, np.arange(buckets, dtype=np.uint64) << np.uint64(bits)), len(contexts)) if buckets > 1 else np.array([0, len(contexts)])
    return [_pack(_planes(contexts[a:b]), *(x[a:b].astype(_least(x[a:b])) for x in values)) for a, b in zip(cut, cut[1:], strict=False)]


def _least(x: np.ndarray) -> type:
    """The smallest type of integer for the values of ``x``."""
    top = int(x.max()) if len(x) else 0
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64


def context_totals(rows: DataFrame, buckets: int, sweep: int) -> DataFrame:
    """``part, sweep, bucket, data``: for each block of a part's contexts the sums
    of the values over all parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_part(batches, "bucket", "part"):
            got = [_unpack(data) for _, data in held]
            keys = [_unplanes(x[0]) for x in got]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = [np.bincount(place, weights=np.concatenate([x[i] for x in got])).astype(np.int64) for i in range(1, len(got[0]))]
            cut = np.cumsum([0, *map(len, keys)])
            for (part, _), a, b in zip(held, cut, cut[1:], strict=False):
                out = [x[place[a:b]] for x in sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([sweep], pa.int32()), pa.array([bucket], pa.int32()), pa.array([_pack(*(x.astype(_least(x)) for x in out))], pa.binary())],
                    names=["part", "sweep", "bucket", "data"])

    dealt = rows.where("bucket is not null").select("bucket", "part", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket", "part")
    return cut_lineage(dealt.mapInArrow(run, "part int, sweep int, bucket int, data binary"))


def _local(totals: pa.Table, setting: Setting, states: list[State]) -> tuple[Setting, list[State]]:
    """Setting and states with the totals of one part's contexts."""
    got: dict[int, list[tuple[int, tuple]]] = {}
    for sweep, bucket, data in zip(*(totals.column(c).to_pylist() for c in ("sweep", "bucket", "data")), strict=True):
        got.setdefault(sweep, []).append((bucket, _unpack(data)))

    def vector(sweep: int, i: int) -> np.ndarray:
        return np.concatenate([[0], *(x[i] for _, x in sorted(got[sweep], key=lambda x: x[0]))]).astype(np.int64)

    return (Setting(setting.types, vector(0, 1), setting.discounts),
            [State(vector(s, 0), x.customers, x.tables, x.frequent_p) for s, x in enumerate(states)])


def _add(sums: dict[int, int], keys: np.ndarray, values: np.ndarray) -> None:
    total = np.bincount(keys, weights=values)
    for k in np.flatnonzero(total).tolist():
        sums[k] = sums.get(k, 0) + int(total[k])


def _part_sums(part: Part, customers: np.ndarray, root_tables: np.ndarray) -> dict[int, int]:
    sums: dict[int, int] = {}
    _add(sums, part.number[~part.rare] - 1, customers[~part.rare])
    sums[ROOT_CUSTOMERS], sums[ROOT_TABLES] = int(customers[part.rare].sum()), int(root_tables[part.rare].sum())
    return sums


def _collect(rows: DataFrame) -> dict[int, int]:
    """Sums by key over all parts: at most the frequent words and a few."""
    return {r.key: r.total for r in rows.where("key is not null").groupBy("key").agg(F.sum("value").alias("total")).collect()}


def _vector(sums: dict[int, int], n: int) -> np.ndarray:
    return np.array([sums.get(i, 0) for i in range(n)], np.int64)


def _discount(ones: int, twos: int) -> float:
    """Discount from the numbers of dishes with one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def sample(blocks: DataFrame, vocab: Vocabulary) -> tuple[Setting, list[State], DataFrame]:
    """Seat the training tokens and return the states before each sweep and
    after the last; what they tell of contexts comes as ``context_totals``."""
    spark = blocks.sparkSession
    buckets = vocab.buckets

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in _by_part(batches):
            part, contexts, _ = _load(held)
            customers = part.fixed + np.bincount(part.word[part.seated], minlength=len(part.number))
            sums = _part_sums(part, customers, np.minimum(customers, 1))
            size = np.bincount(part.ctx - 1, weights=part.count, minlength=len(contexts))
            tables = np.bincount(part.ctx - 1, weights=part.count > 0, minlength=len(contexts))
            sums[ONES], sums[TWOS] = int((part.count == 1).sum()), int((part.count == 2).sum())
            sums[ROOT_ONES], sums[ROOT_TWOS] = int((customers[part.rare] == 1).sum()), int((customers[part.rare] == 2).sum())
            # What seating needs: types of two customers or more, and words that
            # have such a type or two root customers. Others have one table.
            keep = np.zeros(len(part.number), bool)
            keep[part.word[part.seated]] = True
            keep |= part.rare & (customers > 1)
            place = np.cumsum(keep) - 1
            t = part.seated
            lone = np.bincount(part.ctx[part.count == 1] - 1, minlength=len(contexts))
            rest = [int(customers[part.rare & ~keep].sum()), np.bincount(part.number[~part.rare & ~keep], weights=customers[~part.rare & ~keep]).astype(np.int64)]
            data = _pack(part.number[keep], place[part.word[t]].astype(np.int32), part.ctx[t].astype(np.int32), part.count[t], part.fixed[keep], part.total[keep], _planes(contexts), lone.astype(_least(lone)), *map(np.asarray, rest))
            yield from _sums_batch(sums, name, data, _by_bucket(buckets, contexts, tables.astype(np.int64), size.astype(np.int64))).to_batches()
            held.clear()
            del part, contexts, _, customers, size, tables, keep, place, lone, data
            release_memory()

    grouped = blocks.where("part >= 0").sortWithinPartitions("part", "slice")
    first = cut_lineage(grouped.mapInArrow(counts, _SUMS))
    sums = _collect(first)
    n_freq = len(vocab.frequent)
    setting = Setting(vocab.types, np.empty(0), (_discount(sums.get(ROOT_ONES, 0), sums.get(ROOT_TWOS, 0)), _discount(sums.get(ONES, 0), sums.get(TWOS, 0))))
    frequent: Tables | None = None

    def state_of(sums: dict[int, int], s: int) -> State:
        """Seat the root dishes of the frequent words and sum up the root."""
        nonlocal frequent
        rng = np.random.default_rng([13, s])
        c = _vector(sums, n_freq)
        rare = sums.get(ROOT_TABLES, 0)
        weight = np.full(n_freq, setting.root_weight(rare + (int(frequent.t.sum()) if frequent else n_freq)))
        if frequent is None:
            frequent = Tables(c, weight, c, rng)
        else:
            frequent.resize(c, weight, setting.discounts[0], rng)
        frequent.sweep(weight, setting.discounts[0], rng)
        state = State(np.empty(0), sums.get(ROOT_CUSTOMERS, 0) + int(c.sum()), rare + int(frequent.t.sum()), np.empty(0))
        return State(state.context_tables, state.customers, state.tables, setting.root_p(frequent.c, frequent.t, state))

    def seater(shared: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def seat(stats: pa.Table, totals: pa.Table) -> pa.Table:
            number, word, ctx, count, fixed, total, contexts, lone, others, frequent_rest = _unpack(stats.column("data")[0].as_py())
            name = stats.column("part")[0].as_py()
            part = Part(number, word.astype(np.int64), ctx.astype(np.int64), count)
            part.fixed, part.total = fixed, total
            for tables, customers, root_tables in part.sweeps(name, *_local(totals, *shared.value)):
                pass
            sums = _part_sums(part, customers, root_tables)
            _add(sums, np.arange(max(0, len(frequent_rest) - 1)), frequent_rest[1:])
            sums[ROOT_CUSTOMERS] += int(others)
            sums[ROOT_TABLES] += int(others)  # one customer, one table each
            by_context = lone + np.bincount(part.ctx - 1, weights=tables, minlength=len(lone)).astype(np.int64)
            return _sums_batch(sums, name, None, _by_bucket(buckets, _unplanes(contexts), by_context))

        return seat

    states = [state_of(sums, 0)]
    totals = context_totals(first, buckets, 0)
    stats = checkpoint_dealt(first.where("key is null and bucket is null").select("part", "data"), vocab.parts, "part")
    del first
    drop_unused(spark)
    for s in range(SWEEPS):
        shared = spark.sparkContext.broadcast((setting, states))
        seated = cut_lineage(stats.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(seater(shared), _SUMS))
        states.append(state_of(_collect(seated), s + 1))
        totals = totals.unionAll(context_totals(seated, buckets, s + 1))
        del seated
        drop_unused(spark)
    return setting, states, totals


def score_blocks(blocks: DataFrame, vocab: Vocabulary, setting: Setting, states: list[State], totals: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` of every
    document in ``blocks``."""
    shared = blocks.sparkSession.sparkContext.broadcast((vocab, setting, states))

    def score(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        name, names, blobs = blocks.column("part")[0].as_py(), blocks.column("slice").to_pylist(), blocks.column("data").to_pylist()
        if name >= 0:
            names, blobs = zip(*part_scores(name, list(zip(names, blobs, strict=True)), totals), strict=True)
            release_memory()
        return pa.table([pa.array(names, pa.int64()), pa.array(blobs, pa.binary()), pa.array([name < 0] * len(names))], names=["slice", "data", "docs"])

    def part_scores(name: int, held: list[tuple[int, bytes]], totals: pa.Table) -> Iterator[tuple[int, bytes]]:
        v = shared.value[0]
        setting, states = _local(totals, *shared.value[1:])
        part, _, entries = _load(held)
        d1 = setting.discounts[1]
        # The types and words that seating keeps, in its order.
        customers = part.fixed + np.bincount(part.word[part.seated], minlength=len(part.number))
        keep = np.zeros(len(part.number), bool)
        keep[part.word[part.seated]] = True
        keep |= part.rare & (customers > 1)
        place = np.cumsum(keep) - 1
        seating = Part(part.number[keep], place[part.word[part.seated]], part.ctx[part.seated], part.count[part.seated])
        seating.fixed, seating.total = part.fixed[keep], part.total[keep]
        mean, samples = np.zeros(len(part.word)), 0
        t = np.where((part.ctx > 0) & (part.count > 0), 1, 0)
        root_c, root_t = customers.copy(), np.minimum(customers, 1)
        for s, (tables, c, tables0) in enumerate(seating.sweeps(name, setting, states[:-1])):
            if s < BURN_IN:
                continue
            state = states[s + 1]
            t[part.seated], root_c[keep], root_t[keep] = tables, c, tables0
            p = setting.root_p(root_c, root_t, state)
            if len(state.frequent_p):
                p = np.where(part.rare, p, state.frequent_p[np.maximum(part.number - 1, 0)])
            p = p[part.word]
            size = setting.context_customers[part.ctx]
            inner = (part.count - d1 * t + (STRENGTH + d1 * state.context_tables[part.ctx]) * p) / (STRENGTH + size)
            mean += np.where((part.ctx > 0) & (size > 0), inner, p)
            samples += 1
        log_p = np.log10(mean / samples)
        c = np.where(part.rare, part.total, v.counts[np.maximum(part.number - 1, 0)] if len(v.counts) else 0)
        log_base = np.log10((c + 1) / (v.tokens + v.types + 1))[part.word]
        known = (c > 0)[part.word]
        at, n, doc, kind = 0, entries["n"], entries["doc"].astype(np.int64), entries["kind"]
        for s, docs, size in zip(entries["slices"], entries["docs"], entries["sizes"], strict=True):
            d, k, m = doc[at:at + size], kind[at:at + size], n[at:at + size]
            at += size
            # Sums of the documents that hold words of this part, no others.
            held_docs, d = np.unique(d, return_inverse=True)
            sums = [np.bincount(d, weights=w) for w in (m * log_base[k], m * log_p[k], m * known[k])]
            yield s, _pack(held_docs.astype(np.uint16), sums[0], sums[1], sums[2].astype(np.uint32))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(docs: tuple, sums: list[np.ndarray]) -> pa.RecordBatch:
            ids, missing, out, tokens = docs
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=missing), pa.array(out), pa.array(tokens.astype(np.int64)), pa.array(sums[2, :len(ids)].astype(np.int64)), pa.array(sums[0, :len(ids)]), pa.array(sums[1, :len(ids)])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        now, docs, sums = None, None, np.zeros((3, 65_536))
        for batch in batches:
            for s, data, is_docs in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                if s != now and docs is not None:
                    yield done(docs, sums)
                    docs, sums = None, np.zeros((3, 65_536))
                now = s
                got = _unpack(data)
                if is_docs:
                    docs = got
                else:
                    sums[:, got[0]] += np.stack(got[1:])  # a part names a document once
        if docs is not None:
            yield done(docs, sums)
        release_memory()

    scored = blocks.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(score, "slice long, data binary, docs boolean")
    return scored.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row of ``docs``.

    Learns from the rows whose crc32 of the id modulo 7 is not 2. A null text is
    empty and consists of the end token. A row without id is scored but not
    learned from, nor held out. Repeated rows are learned from and scored as
    often as they occur. With nothing to learn from, the one unknown word has
    all probability. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    vocab = vocabulary(docs.where(crc_mod("doc_id", 7) != 2).select(F.col("text").cast("string").alias("text")))
    drop_unused(docs.sparkSession)
    blocks = checkpoint_dealt(occurrences(docs, vocab), vocab.parts, "part")
    drop_unused(docs.sparkSession)
    setting, states, totals = sample(blocks, vocab)
    scored = score_blocks(blocks, vocab, setting, states, totals)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
