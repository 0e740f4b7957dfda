"""Hard-negative mining by a secondary-sort shuffle (operator 11).

For an anchor, other rows of its label are its positives, rows of another label
its negatives, and the score of a row is its integer inner product with the
anchor. Each of the anchor's first positives opens a window of scores, from
``low_percent`` of the positive's score up to that score, and the window takes
the first negatives that fall in it.

How the work is spread. Anchors are dealt in blocks and all rows in groups; a
cell (anchor block, row group) is scored by one task, which holds the anchors'
vectors and lets the rows stream past in Arrow batches. Of the pairs it scores
a cell sends on only what can still count, so the shuffle is linear in the
anchors:

1. the first positives of each anchor by cell, then over all cells;
2. the first negatives by cell of each of those positives' windows.

Their scores are packed into keys (anchor, descending score, positives before
negatives, id) whose bytes sort as the tuple does.
``repartitionAndSortWithinPartitions`` deals keys by anchor and sorts them in the
shuffle; an iterator reads an anchor's rows in that order, opens a window at
each positive and gives a negative to every window that still has room. It
holds the windows of one anchor, never its rows.

Results in odd cases. Rows without vec_id, label or vector and rows with a null
or non-finite component take no part. Rows that repeat a vec_id are one row, the
least (label, vector) of them. Vectors of different lengths have no inner
product and never meet; those of length 0 score 0. Scaled components are held
within +-2**24, so that a score fits a long (vectors of up to 2**15 components). Equal scores go by vec_id. Columns
beyond vec_id, embedding and label are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_path, shuffle_partitions

POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
#: Anchors that a task holds at a time.
ANCHOR_BLOCK = 4096
#: Groups that the rows are dealt into for each block of anchors. Constant, so
#: that what the cells send on grows with the anchors alone; with more rows
#: there are more blocks, hence more cells.
ROW_GROUPS = 16
#: Scores that a task computes at a time.
SCORES = 1 << 21
_LIMIT = float(1 << 24)

_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_CANDIDATE = "anchor_id long, vec_id long, score long"
_FLIP = 1 << 63
_KEY = struct.Struct(">QQBQ")


def pack_key(anchor: int, score: int, negative: bool, vec_id: int) -> bytes:
    """Bytes that sort by anchor, then descending score, then positives before
    negatives, then vec_id."""
    return _KEY.pack(anchor + _FLIP, _FLIP - 1 - score, negative, vec_id + _FLIP)


def unpack_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, vec_id = _KEY.unpack(key)
    return anchor - _FLIP, _FLIP - 1 - score, bool(negative), vec_id - _FLIP


def deal(key: bytes) -> int:
    """Partition of a key: by its anchor alone."""
    return zlib.crc32(key[:8])


def windows(keys: Iterable[tuple[bytes, None]], positives: int, negatives: int, low_percent: int) -> Iterator[tuple]:
    """Rows (anchor, positive, rank, negative, positive score, negative score)
    from keys in order. Holds at most ``positives`` windows, each a positive, its
    score and the number of negatives it has taken."""
    current, opened, wide = None, 0, []
    for key, _ in keys:
        anchor, score, negative, vec_id = unpack_key(key)
        if anchor != current:
            current, opened, wide = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                wide.append([vec_id, score, 0])
            continue
        for w in wide:
            if low_percent * w[1] <= 100 * score <= 100 * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], vec_id, w[1], score
        wide = [w for w in wide if w[2] < negatives and low_percent * w[1] <= 100 * score]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` and ``b`` (float64 in which
    every component is whole): in the least type that holds every partial sum."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _first(owner: np.ndarray, score: np.ndarray, vec_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` rows of each owner by descending score, then id."""
    order = np.lexsort((vec_id, -score, owner))
    at = owner[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return order[place < n]


class _Cell:
    """The first rows of each list of the anchors of one cell, as rows stream by.

    In the first pass every anchor has one list, its positives. In the second it
    has one for each of its positives' scores, which takes negatives from
    ``low`` to ``high``. ``floor`` is the last score that can still enter a list.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, n: int):
        self.ids, self.labels, self.vectors, self.owner = ids, labels, vectors, owner
        self.high, self.floor, self.same, self.n = high, low.copy(), same, n
        self.held = tuple(np.empty(0, np.int64) for _ in range(3))  # list, score, vec_id

    def take(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(ids)))
        found = [self.held]
        for a in range(0, len(self.owner), step):
            lists = np.arange(a, min(a + step, len(self.owner)))
            own = self.owner[lists]
            inner, back = np.unique(own, return_inverse=True)
            scores = _product(self.vectors[inner], vectors)[back]
            fits = (scores >= self.floor[lists, None]) & (scores <= self.high[lists, None])
            fits &= (self.labels[own][:, None] == labels) == self.same
            if self.same:
                fits &= self.ids[own][:, None] != ids
            i, j = np.nonzero(fits)
            found.append((lists[i], scores[i, j], ids[j]))
        owner, score, vec_id = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = _first(owner, score, vec_id, self.n)
        self.held = owner[keep], score[keep], vec_id[keep]
        full = np.flatnonzero(np.bincount(self.held[0], minlength=len(self.owner)) >= self.n)
        least = np.full(len(self.owner), np.iinfo(np.int64).max)
        np.minimum.at(least, self.held[0], self.held[1])
        self.floor[full] = least[full]

    def result(self) -> pa.RecordBatch:
        lists, score, vec_id = self.held
        rows = np.unique(np.stack([self.ids[self.owner[lists]], vec_id, score]), axis=1) if len(lists) else np.empty((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["anchor_id", "vec_id", "score"])


def _score_cells(same: bool, n: int, low_percent: int):
    """Streams a partition's rows, sorted by cell with a cell's anchors first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, anchors = None, None, []

        def opened() -> _Cell:
            ids, labels, vectors, marks = (np.concatenate([x[k] for x in anchors]) if k < 3 else [m for x in anchors for m in x[3]] for k in range(4))
            if same:
                owner = np.arange(len(ids))
                low = np.full(len(ids), np.iinfo(np.int64).min)
                high = np.full(len(ids), np.iinfo(np.int64).max)
            else:
                owner = np.repeat(np.arange(len(ids)), [len(m) for m in marks])
                high = np.array([s for m in marks for s in m], np.int64)
                low = np.array([-(-low_percent * s // 100) for m in marks for s in m], np.int64)
            return _Cell(ids, labels, vectors, owner, low, high, same, n)

        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            is_row = batch.column("is_row").to_numpy(zero_copy_only=False)
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            lists = batch.column("vector")
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_row) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    if held is not None:
                        yield held.result()
                    cell, held, anchors = cells[a], None, []
                part = lists.slice(a, b - a)
                vectors = part.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1) if len(part.flatten()) else np.zeros((b - a, 0))
                if not is_row[a]:
                    anchors.append((ids[a:b], labels[a:b], vectors, batch.column("marks").slice(a, b - a).to_pylist()))
                elif anchors:
                    held = held or opened()
                    held.take(ids[a:b], labels[a:b], vectors)
        if held is not None:
            yield held.result()

    return run


def _cells(rows: DataFrame, anchors: DataFrame, blocks: dict[int, tuple[int, int]], groups: int) -> DataFrame:
    """Every anchor once for each row group and every row once for each anchor
    block of its vectors' length, dealt and sorted by cell, anchors first."""
    spread, number = (F.create_map(*[x for d, b in blocks.items() for x in (F.lit(d), F.lit(b[k]).cast("long"))]) for k in (0, 1))
    size = F.size("vector")
    block = spread[size] + F.pmod(F.xxhash64(F.lit(1), "vec_id"), number[size])
    group = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(groups))
    columns = ["cell", "is_row", "vec_id", "label", "vector", "marks"]
    left = anchors.withColumn("is_row", F.lit(0)).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: block * groups + g))).select(columns)
    right = rows.where(size.isin(list(blocks))).withColumns({"is_row": F.lit(1), "marks": F.lit(None).cast("array<long>")}).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), number[size] - 1), lambda b: (spread[size] + b) * groups + group))).select(columns)
    cells = sum(n for _, n in blocks.values()) * groups
    return left.unionByName(right).repartition(cells, "cell").sortWithinPartitions("cell", "is_row")


def scaled(rows: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part: components
    ``floor(256 * x)`` as whole doubles, one row a vec_id."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.floor(v.cast("double") * 256).cast("double"))))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    one = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), whole.alias("vector")).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vector")


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
          label: Column | None = None, anchor_block: int = ANCHOR_BLOCK, row_groups: int = ROW_GROUPS) -> DataFrame:
    """Hard negatives of every anchor, see the module.

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is a condition on
    vec_id; ``label`` may replace the label by an expression. Returns
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "hard-negatives")
    scaled(rows, F.col("label") if label is None else label).write.parquet(path)
    rows = spark.read.parquet(path)
    anchors = rows.where(is_anchor)
    # One row for each length of the vectors: how many blocks its anchors make.
    lengths = anchors.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()
    blocks, total = {}, 0
    for r in lengths:
        n = -(-r["count"] // anchor_block)
        blocks[r["d"]] = (total, n)
        total += n
    if not blocks:
        return spark.createDataFrame([], _MINED)
    none = F.lit(None).cast("array<long>").alias("marks")
    best = _cells(rows, anchors.select("*", none), blocks, row_groups).mapInArrow(_score_cells(True, positives, low_percent), _CANDIDATE)

    def first(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple]:
        """The first positives of each anchor, from keys in order."""
        current, taken = None, 0
        for key, _ in keys:
            anchor, score, _, vec_id = unpack_key(key)
            current, taken = (current, taken + 1) if anchor == current else (anchor, 1)
            if taken <= positives:
                yield anchor, vec_id, score

    def sort(rdd, partitions: int):
        return rdd.repartitionAndSortWithinPartitions(partitions, deal)

    partitions = max(1, min(shuffle_partitions(spark), total * row_groups))
    chosen_path = shared_path(spark, "positives")
    keyed = best.rdd.map(lambda r: (pack_key(r[0], r[2], False, r[1]), None))
    spark.createDataFrame(sort(keyed, partitions).mapPartitions(first), _CANDIDATE, verifySchema=False).write.parquet(chosen_path)
    chosen = spark.read.parquet(chosen_path)
    marked = anchors.join(chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("score")).alias("marks")), "vec_id")
    near = _cells(rows, marked, blocks, row_groups).mapInArrow(_score_cells(False, negatives, low_percent), _CANDIDATE)
    every = chosen.select("*", F.lit(False).alias("negative")).unionByName(near.select("*", F.lit(True).alias("negative")))
    keys = every.rdd.map(lambda r: (pack_key(r[0], r[2], r[3], r[1]), None))
    out = sort(keys, partitions).mapPartitions(lambda some: windows(some, positives, negatives, low_percent))
    return spark.createDataFrame(out, _MINED, verifySchema=False)
