"""Benchmark decontamination (operator 1).

Every document is read in windows as long as a benchmark item. Windows that
share no word shingle with an item cannot be similar to it and are passed over;
the others get SimHash fingerprints from running sums over the document. Each
byte of an item's fingerprint is a block of a multi-index: if two fingerprints
differ in at most 23 bits, one of their eight bytes differs in at most two, so
looking up all bytes within two bits finds every fingerprint within the radius,
and the exact distance leaves those alone. A window is compared with the items
that share a shingle with its text. Candidates are verified by the exact weighted similarity of their shingles.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgerlens.llm.common import as_bytes, shared_path

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Largest number of differing bits of a candidate's fingerprints. A pair at
#: similarity 0.8 differs in about 10 of 64 bits, with a deviation of about 3.
RADIUS = 23
#: Bytes of benchmark text that one pass holds against all documents; a larger
#: benchmark is taken in blocks of this size.
BLOCK_BYTES = 8_000_000
#: Windows fingerprinted at a time.
WINDOWS = 8192
#: Bytes of text tokenised at a time.
TEXT_BYTES = 2 << 20

_BITS = 64
_BLOCKS = 8
#: ASCII letters lower-cased, ASCII punctuation as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c in b" \t\n\x0b\x0c\r" else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Byte values within two bits of each byte value.
_NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // _BLOCKS for b in range(256)] for a in range(256)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all runs of ``k`` word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + words[j:j + n]
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[k:] - total[:-k]


def _signed(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of 64 signed weights, one for each bit of a shingle's hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    return (2 * bits - 1) * weights[:, None]


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=-1, bitorder="little")).view("<u8")[..., 0]


class Item:
    """A benchmark item: shingles with the characters they hold as weights."""

    def __init__(self, item_id: int, words: list[bytes]):
        self.id, self.n = item_id, len(words)
        self.k = min(SHINGLE_WORDS, self.n)
        self.hashes = shingle_hashes(word_hashes(words), self.k)
        weights = _sums(np.fromiter(map(len, words), np.int64, len(words)), self.k)
        self.weight = dict(zip(self.hashes.tolist(), weights.tolist(), strict=True))
        self.count = Counter(self.hashes.tolist())
        self.total = int(weights.sum())
        self.fingerprint = _packed(_signed(self.hashes, weights).sum(axis=0)[None])[0]

    def similarity(self, hashes: np.ndarray, weights: np.ndarray) -> float:
        """Weight of shingles in common over the weight of either's, repeats
        counted."""
        held: Counter = Counter(hashes.tolist())
        common = sum(min(c, held[h]) * self.weight[h] for h, c in self.count.items() if h in held)
        return common / (self.total + int(weights.sum()) - common)


class Index:
    """The items of one block: shingles by length, fingerprints by bytes."""

    def __init__(self, items: list[tuple[int, bytes]]):
        held = [Item(i, w) for i, t in items if (w := words_of(t))]
        self.groups: dict[int, list[Item]] = defaultdict(list)  # by number of words
        for item in held:
            self.groups[item.n].append(item)
        by_k: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        for n, items_of in self.groups.items():
            for j, item in enumerate(items_of):
                by_k[item.k].update((h, n, j) for h in item.hashes.tolist())
        #: By shingle length: sorted hashes, where the items of each begin, those
        #: items (number of words, place in its group), a filter.
        self.known = {}
        for k, held_by in by_k.items():
            rows = sorted(held_by)
            keys, first = np.unique(np.array([h for h, _, _ in rows], np.uint64), return_index=True)
            seen = np.zeros(1 << 18, bool)
            seen[keys >> np.uint64(46)] = True
            self.known[k] = (keys, np.append(first, len(rows)), np.array([(n, j) for _, n, j in rows], np.int64), seen)
        self.fingerprints = {n: np.array([x.fingerprint for x in xs], np.uint64) for n, xs in self.groups.items()}
        #: By number of words: [block, byte, item] tells a block within its radius.
        self.blocks = {n: np.stack([_NEAR[:, row] for row in f.astype("<u8").view(np.uint8).reshape(-1, _BLOCKS).T]) for n, f in self.fingerprints.items()}

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows (position, item's number of words, item's place in its group) of
        all shingles of items, by position."""
        out = [np.empty((0, 3), np.int64)]
        for k, (keys, first, items, seen) in self.known.items():
            h = shingle_hashes(words, k)
            at = np.flatnonzero(seen[h >> np.uint64(46)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[place] == h[at]
            at, place = at[ok], place[ok]
            many = first[place + 1] - first[place]
            of = np.repeat(first[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            out.append(np.column_stack([np.repeat(at, many), items[of]]))
        rows = np.concatenate(out)
        return rows[np.lexsort(rows.T[::-1])]

    def matches(self, words: np.ndarray, sizes: np.ndarray, hits: np.ndarray) -> list[dict]:
        """The best window of each item that some window is similar to; an item
        without a shingle in the text is similar to none."""
        best: dict[int, dict] = {}
        for n in np.unique(hits[:, 1]).tolist():
            mine = hits[hits[:, 1] == n]
            at, items = np.unique(mine[:, 0]), np.unique(mine[:, 2])
            k = min(SHINGLE_WORDS, n)
            span = min(n, len(words))  # a shorter document is one window
            last = len(words) - span
            # Starts of windows that hold a hit: covered by any [p - span + k, p].
            edge = np.zeros(last + 2, np.int64)
            low, high = np.clip(at - span + k, 0, last), np.clip(at, 0, last)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            width = span - k + 1
            for a in range(0, len(starts), WINDOWS):
                some = starts[a:a + WINDOWS]
                for run in np.split(some, np.flatnonzero(np.diff(some) > span) + 1):
                    self._verify(n, k, width, run, items, words, sizes, best)
        return list(best.values())

    def _verify(self, n: int, k: int, width: int, starts: np.ndarray, items: np.ndarray, words: np.ndarray, sizes: np.ndarray, best: dict[int, dict]) -> None:
        """Windows from ``starts`` against ``items`` of n words: the blocks leave
        those that may lie within the radius, exact bits those that do, and their
        shingles decide."""
        first, stop = int(starts[0]), int(starts[-1]) + width + k - 1
        h, w = shingle_hashes(words[first:stop], k), _sums(sizes[first:stop], k)
        total = np.concatenate([np.zeros((1, _BITS), np.int64), np.cumsum(_signed(h, w), axis=0)])
        at = starts - first
        prints = _packed(total[at + width] - total[at])
        parts = prints.astype("<u8").view(np.uint8).reshape(-1, _BLOCKS)
        near = np.zeros((len(starts), len(items)), bool)
        for b in range(_BLOCKS):
            near |= self.blocks[n][b][:, items][parts[:, b]]
        i, j = np.nonzero(near)
        j = items[j]
        distance = np.bitwise_count(prints[i] ^ self.fingerprints[n][j])
        close = distance <= RADIUS
        for i, j, bits in zip(i[close].tolist(), j[close].tolist(), distance[close].tolist(), strict=True):
            item, s = self.groups[n][j], int(at[i])
            likeness = item.similarity(h[s:s + width], w[s:s + width])
            if likeness >= MIN_SIMILARITY and ((old := best.get(item.id)) is None or likeness > old["similarity"]):
                best[item.id] = {"item_id": item.id, "similarity": likeness, "start": int(starts[i]), "end": int(starts[i]) + width + k - 1, "bits": bits}


_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.int32())]))
_MATCH_SQL = "array<struct<item_id:long,similarity:double,start:int,end:int,bits:int>>"


def _matcher(items: list[tuple[int, bytes]]):
    """Column function: the matches of a text with the items of one block."""

    @arrow_udf(_MATCH_SQL)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(items)
        for texts in batches:
            out: list[list[dict]] = []
            held: list[list[bytes]] = []
            size = 0

            def flush() -> None:
                bounds = np.cumsum([0, *map(len, held)])
                flat = [w for ws in held for w in ws]
                hashes = word_hashes(flat)
                # One search over the slice; what crosses a document's end goes.
                where = index.hits(hashes)
                doc = np.searchsorted(bounds, where[:, 0], side="right") - 1
                inside = where[:, 0] + np.minimum(SHINGLE_WORDS, where[:, 1]) <= bounds[np.minimum(doc + 1, len(held))]
                where, doc = where[inside], doc[inside]
                edge = np.searchsorted(doc, np.arange(len(held) + 1))
                for d, (ws, a, b) in enumerate(zip(held, edge, edge[1:], strict=False)):
                    if a == b:
                        out.append([])
                        continue
                    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
                    out.append(index.matches(hashes[bounds[d]:bounds[d + 1]], sizes, where[a:b] - [int(bounds[d]), 0, 0]))
                held.clear()

            for text in as_bytes(texts):
                held.append(words_of(text))
                size += len(text)
                if size >= TEXT_BYTES:
                    flush()
                    size = 0
            flush()
            yield pa.array(out, _MATCH)

    return found


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """The items in blocks of about ``block_bytes`` of text, one at a time on the
    driver, each with whether it is the last; repeated rows and rows without
    item_id or text are left out."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield sorted((r.item_id, r.text.encode()) for r in part.toLocalIterator()), b == blocks - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, similarity, start, end, bits``: one row for each row of
    ``docs`` and item that a window of its text is similar to at 0.8 or more.

    Words are cut at white space and ASCII punctuation, A-Z lower-cased; an item
    of fewer than five words is one shingle. Null and empty texts, items without
    words and empty tables match nothing. Repeated rows match alike; two items
    of equal text both match. Other columns are not read.

    A benchmark beyond ``block_bytes`` is held against all documents block by
    block, each block's rows written before the next one is loaded: driver and
    tasks hold one block whatever its size.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    path = None
    for items, last in benchmark_blocks(benchmark, block_bytes):
        found = rows.select("doc_id", F.explode(_matcher(items)(F.col("text"))).alias("m")).select("doc_id", "m.*")
        if last and path is None:
            return found
        path = path or shared_path(spark, "matches")
        found.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item; what one
    block of a large benchmark leaves is written before the next is loaded."""
    for items, last in benchmark_blocks(benchmark, block_bytes):
        docs = docs.where(F.size(_matcher(items)(F.col("text").cast("string"))) == 0)
        if not last:
            path = shared_path(docs.sparkSession, "clean")
            docs.write.parquet(path)
            docs = docs.sparkSession.read.parquet(path)
    return docs
