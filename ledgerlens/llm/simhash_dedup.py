"""SimHash near-dedup by segment-popcount embedding (operator 6).

A 64-bit fingerprint is mapped to its numbers of set bits in 32 segments of two
bits, a point of an integer grid. Flipping one bit moves the point by one step,
so the Manhattan distance of two points never exceeds the Hamming distance of
their fingerprints. If it is at most 3 in all, it is at most 1 in one of the two
halves of 16 coordinates. The grid range-join therefore meets every linked pair
in a cell of one half: each fingerprint stands in its own cell and in the cells
one step up, so two points one step apart meet in the upper one's cell. Pairs
that meet are filtered by the Manhattan distance of the whole points and then
verified by the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, cut_lineage, shuffle_partitions, slices

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
#: Rows of one grid cell that one task compares; a larger cell is dealt in
#: pairs of blocks of this size.
CELL_ROWS = 20_000

_LOW = 0x5555555555555555


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text in UTF-8: A-Z lower-cased, words cut at white
    space, word shingles with repeats, XXH64 with seed 42; a bit is set if it is
    set in more than half of the hashes. No word: 0. Fewer words than a shingle
    has: the whole sequence is the only shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, HASH_SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = np.array([digest(joined[a:b - 1], HASH_SEED) for a, b in zip(starts, ends[shingle_words - 1:], strict=False)],
                      dtype="<u8")
    n = len(hashes)
    # One byte per bit, eight bytes to a lane: 255 rows add up without overflow.
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(n, 8)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    ones = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp``: one row per row of ``docs`` (null text: empty),
    fp as a signed long, text_hash as :func:`_text_hash`. Other columns, whatever
    their names, are not read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([simhash(t, shingle_words) for t in as_bytes(part.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _text_hash(text_col: str = "text") -> Column:
    """A hash that tells texts of one doc_id apart, null from empty too."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(text.isNull(), text)


def grid_cells(fps: DataFrame) -> DataFrame:
    """``cell, fp``: every distinct fingerprint in its own cell and the cells one
    step up, for both halves of the grid."""
    halves = F.array(*[
        F.struct(F.lit(i).cast("long").alias("half"), F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits"))
        for i in (0, 1)])
    rows = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.bits")
    # Two-bit fields of a half become their numbers of set bits.
    rows = rows.select("fp", "half", (F.col("bits") - F.shiftright("bits", 1).bitwiseAND(F.lit(0x55555555))).alias("point"))
    # A count of 0 or 1 may rise by one; a count of 2 (binary 10) is full.
    up = F.expr("transform(filter(sequence(0, 15), i -> (shiftright(point, 2 * i) & 3) < 2), i -> point + shiftleft(1L, 2 * i))")
    cells = F.concat(F.array(F.col("point")), up)
    return rows.select("fp", F.explode(F.transform(cells, lambda c: c * 2 + F.col("half"))).alias("cell"))


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed two-bit counts: fields 0, 1, 2 differ by one
    unless their exclusive or is binary 10."""
    d, low = x ^ y, np.uint64(_LOW)
    one = d & low
    return np.bitwise_count(one).astype(np.int16) + 2 * np.bitwise_count((d >> np.uint64(1)) & low & ~one)


def _links(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join one cell's fingerprints into their components: every
    fingerprint is compared with those that no search has reached yet, so a
    dense cell costs little more than its size and emits fewer links than
    fingerprints."""
    low = np.uint64(_LOW)
    counts = fps - ((fps >> np.uint64(1)) & low)
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _manhattan(counts[left], counts[at]) <= max_bits
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= max_bits
            hit = left[near]
            if len(hit):
                out.append((np.full(len(hit), fps[at]), fps[hit]))
                queue.extend(hit)
                left = left[~near]
    return out


def _cell_links(max_bits: int):
    def flush(cells: np.ndarray, fps: np.ndarray):
        out_a, out_b = [], []
        start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        size = np.diff(np.r_[start, len(cells)])
        low = np.uint64(_LOW)
        counts = fps - ((fps >> np.uint64(1)) & low)
        small = size <= 64
        row_small = np.repeat(small, size)
        for step in range(1, int(size[small].max(initial=1))):
            same = (cells[step:] == cells[:-step]) & row_small[step:]
            at = np.flatnonzero(same)
            if not len(at):
                continue
            at = at[_manhattan(counts[at], counts[at + step]) <= max_bits]
            at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
            out_a.append(fps[at])
            out_b.append(fps[at + step])
        for i in np.flatnonzero(~small):
            for a, b in _links(fps[start[i]:start[i] + size[i]], max_bits):
                out_a.append(a)
                out_b.append(b)
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        pairs = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]) if len(pairs) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.concatenate([held_c, batch.column("cell").to_numpy()])
            f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
            last = int(np.searchsorted(c, c[-1])) if c[0] != c[-1] else 0  # the last cell may go on
            if last and (got := flush(c[:last], f[:last])) is not None:
                yield got
            held_c, held_f = c[last:], f[last:]
        if len(held_c) and (got := flush(held_c, held_f)) is not None:
            yield got

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` at ``max_bits`` or
    fewer differing bits, enough of them to join every component. The grid's
    guarantee holds for ``max_bits`` up to 3."""
    if max_bits > 3:
        raise ValueError("two halves meet within one step only up to 3 differing bits")
    spark = fps.sparkSession
    cells = grid_cells(fps)
    n = shuffle_partitions(spark)
    hot = cells.groupBy("cell").count().where(F.col("count") > cell_rows) \
        .select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("blocks"))
    # A hot cell's rows are dealt by hash to blocks, and each pair of blocks is a
    # task's group of its own: no group grows past twice cell_rows or so.
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("blocks")).cast("int")
    groups = F.when(F.col("blocks").isNull(), F.array(F.col("cell"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(
            F.col("cell"), F.least(mine, j), F.greatest(mine, j))))
    dealt = cells.join(hot, "cell", "left").select(F.explode(groups).alias("cell"), "fp")
    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_cell_links(max_bits), "a long, b long")


def connected(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches.

    Large-star and small-star rounds, each an aggregate and a join by node; the
    links of a hot node are never gathered. Raises if ``max_rounds`` do not
    suffice (their number grows with the logarithm of the longest path).
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))) \
            .where("u <> v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dedup_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    component_id is the smallest doc_id reached over links, itself included.
    Equal fingerprints are always linked. Null or empty texts have fingerprint
    0 and are linked like any other. A row without doc_id is fingerprinted and
    linked like any other but names no component: with only such rows in a
    component its component_id is null. Repeated rows give repeated rows; an
    empty table gives an empty result.
    """
    return _labelled(docs, shingle_words, max_bits).select("doc_id", "fp", "component_id")


def _labelled(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` of every row; root is the
    least fingerprint of the row's component."""
    fps = cut_lineage(fingerprints(docs, shingle_words))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(fingerprint_links(first.select("fp"), max_bits))
    labels = first.join(roots, first.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(least, "root").select("fp", "component_id", "root")
    return fps.join(labels, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component exactly one, that of the
    smallest doc_id. Rows without doc_id belong to components like others, and
    one stays where a component has no other. Of rows that share the smallest
    doc_id with several texts the one of least hash stays, of equal rows one.
    """
    found = _labelled(docs.select("doc_id", "text"), shingle_words, max_bits)
    # Partial minima before the shuffle: a component of a third of all rows
    # sends one row a task.
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"))
    chosen = chosen.select(F.coalesce("row.doc_id", F.lit(0)).alias("kept_id"), F.col("row.no_id").alias("kept_no_id"), F.col("row.text_hash").alias("kept_hash"))
    keys = ["kept_id", "kept_no_id", "kept_hash"]
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("kept_id"), F.col("doc_id").isNull().alias("kept_no_id"), _text_hash().alias("kept_hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(chosen, keys, "left_semi")
    # Only equal rows (of one id and text) still repeat; the row limit works
    # before the shuffle.
    once = rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("row")))).where("nth = 1")
    return once.select("row.*")
