"""Approximate nearest neighbours by balanced posting lists (operator 2).

Vectors are dealt to posting lists around centroids; a vector near a boundary
stands in several lists. A query searches the graph of the centroids in memory
and reads the lists whose centroids are nearly as near as the nearest one.
Largest inner product becomes smallest distance by one more coordinate that
gives all vectors the same length.

Equal vectors are indexed once, with the smallest of their ids that any answer
can need, so a vector that a third of all rows hold is one entry of a list.
Lists are dealt to groups of bounded size, a list larger than a group to
several; a task joins one group with one block of queries.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage

TOP = 20
#: Bound of the sample that centroids are fitted on, by smallest hash of the id.
SAMPLE = 20_000
#: Distinct vectors a list is to hold, and bounds of the number of lists.
LIST_ROWS = 128
MAX_LISTS = 2048
#: A vector also stands in lists whose centroid is at most this much farther
#: than its nearest, COPIES lists at most in all (its nearest one always).
BOUNDARY_RATIO = 1.10
COPIES = 4
#: A query reads the lists whose centroid is at most this much farther than the
#: nearest.
SEARCH_RATIO = 1.16
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: Entries of lists in one group, and queries in one block.
GROUP_ROWS = 30_000
MIN_GROUPS = 12
QUERY_BLOCK = 20_000


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows with an id and a vector that is not null, empty or
    zero and holds neither nulls nor non-finite numbers, of the length that most
    such vectors have (ties: the longest)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size.n if size else 0))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """``rep, v, ids``: each distinct vector with the ``top + 1`` smallest of its
    ids, all that an answer of ``top`` (own row left out) can hold; rep is the
    smallest. Ranks are limited before the shuffle."""
    ids = rows.distinct().withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= top + 1)
    return ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


@dataclass(frozen=True)
class Centroids:
    """Centroids in the lengthened space and the graph between them."""

    points: np.ndarray
    graph: np.ndarray
    radius: float  # the length that all vectors are brought to

    def lengthened(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(0.0, self.radius ** 2 - (v * v).sum(axis=1)))[:, None]], axis=1)

    def home(self, v: np.ndarray, ratio: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists of vectors: row numbers and list numbers."""
        x = self.lengthened(v)
        d = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ self.points.T + (self.points ** 2).sum(axis=1)))
        near = np.argpartition(d, min(copies, d.shape[1]) - 1, axis=1)[:, :copies]
        dist = np.take_along_axis(d, near, axis=1)
        row, place = np.nonzero(dist <= dist.min(axis=1, keepdims=True) * ratio)
        return row, near[row, place]

    def search(self, q: np.ndarray, ratio: float, sizes: dict[int, int], least: int) -> np.ndarray:
        """Lists of one query: best-first search of the graph from some spread
        points on, as long as the point to expand is within ``ratio`` of the
        nearest found or the lists expanded hold fewer than ``least`` entries;
        then the lists within ``ratio``, and the next ones up to ``least``
        entries. Ratios hold for distances from the query brought to the common
        length, whose direction alone ranks inner products."""
        size = float(np.sqrt(q @ q))
        x = np.concatenate([q * (self.radius / size), [0.0]])
        known: dict[int, float] = {}

        def visit(nodes: np.ndarray) -> None:
            new = np.array([n for n in nodes.tolist() if n not in known], np.int64)
            if len(new):
                d = self.points[new] - x
                for n, dist in zip(new.tolist(), np.sqrt(np.einsum("ij,ij->i", d, d)).tolist(), strict=True):
                    known[n] = dist
                    heapq.heappush(queue, (dist, n))

        queue: list[tuple[float, int]] = []
        visit(np.arange(0, len(self.points), max(1, len(self.points) // 8)))
        best, held = queue[0][0], 0
        while queue and (queue[0][0] <= best * ratio + 1e-12 or held < least):
            _, node = heapq.heappop(queue)
            held += sizes.get(node, 0)
            visit(self.graph[node])
            best = min(best, queue[0][0]) if queue else best
        out, held = [], 0
        for dist, n in sorted((dist, n) for n, dist in known.items()):
            if dist > best * ratio + 1e-12 and held >= least:
                break
            out.append(n)
            held += sizes.get(n, 0)
        return np.array(out, np.int64)


def _halved(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of ``x`` in parts of at most ``size``, by halving between two
    means again and again; halves are equal in number."""
    parts, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        y = x[rows]
        one = y[rng.integers(len(y))]
        two = y[((y - one) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            order = np.argsort(-(y @ (one - two)), kind="stable")
            half = len(rows) // 2
            one, two = y[order[:half]].mean(axis=0), y[order[half:]].mean(axis=0)
        todo += [rows[order[half:]], rows[order[:half]]]
    return parts


def fit(entries: DataFrame, n_entries: int, sample: int = SAMPLE, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> Centroids:
    """Centroids of the distinct vectors ``entries``, from a bounded sample."""
    longest = entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    h = F.xxhash64("rep", F.lit(3))
    rows = entries.select("v", "rep", h.alias("h")).orderBy("h", "rep").limit(sample).toPandas()
    v = np.stack(rows["v"].map(np.asarray).tolist())
    flat = Centroids(np.empty((0, v.shape[1] + 1)), np.empty((0, 0), np.int64), float(np.sqrt(longest)))
    x = flat.lengthened(v)
    lists = int(np.clip(n_entries // list_rows, 1, min(max_lists, max(1, len(x) // 8))))
    parts = _halved(x, -(-len(x) // lists), np.random.default_rng(1))
    points = np.stack([x[p].mean(axis=0) for p in parts])
    for _ in range(2):
        near = ((points ** 2).sum(axis=1) - 2 * x @ points.T).argmin(axis=1)
        held = np.bincount(near, minlength=len(points))
        total = np.zeros_like(points)
        np.add.at(total, near, x)
        points = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], points)
    d = (points ** 2).sum(axis=1)[:, None] - 2 * points @ points.T + (points ** 2).sum(axis=1)
    np.fill_diagonal(d, np.inf)
    k = min(DEGREE, len(points) - 1)
    near = np.argsort(d, axis=1)[:, :k]
    # A ring and one far link each keep the graph in one piece.
    ring = np.stack([(np.arange(len(points)) + 1) % len(points), (np.arange(len(points)) + len(points) // 2) % len(points)], axis=1)
    return Centroids(points, np.concatenate([near, ring], axis=1), flat.radius)


def _groups(sizes: dict[int, int], group_rows: int, min_groups: int) -> dict[int, list[int]]:
    """Groups of every list: runs of neighbouring lists of about equal size; a
    list larger than a group has several."""
    total = sum(sizes.values())
    share = max(1, min(group_rows, -(-total // min_groups)))
    out: dict[int, list[int]] = {}
    group, room = 0, share
    for name in sorted(sizes):
        left, mine = sizes[name], []
        while left > 0:
            mine.append(group)
            used = min(left, room)
            left, room = left - used, room - used
            if not room:
                group, room = group + 1, share
        out[name] = mine
    return out


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, search_ratio: float = SEARCH_RATIO, boundary_ratio: float = BOUNDARY_RATIO,
            copies: int = COPIES, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` largest inner products that
    each row of ``queries`` finds among the rows of ``vectors`` with another id.

    Both have vec_id and embedding. Scores are inner products of the original
    vectors in double precision; ties go to the smaller vec_id. Vectors that
    ``usable`` leaves out take no part as either. Repeated rows count once; of
    an id with several vectors all take part. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    entries = cut_lineage(distinct_vectors(usable(vectors), top))
    n = entries.count()
    asked = usable(queries).distinct()
    if not n or not asked.head(1):
        return spark.createDataFrame([], out)
    dim = len(entries.head().v)
    asked = asked.where(F.size("v") == dim)
    model = spark.sparkContext.broadcast(fit(entries, n, sample, list_rows))  # at most MAX_LISTS points

    def deal(batches):
        for pdf in batches:
            row, lists = model.value.home(np.stack(pdf["v"].map(np.asarray).tolist()), boundary_ratio, copies)
            yield pd.DataFrame({"rep": pdf["rep"].to_numpy()[row], "list": lists})

    posted = entries.select("rep", "v").mapInPandas(deal, "rep long, list int")
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().toLocalIterator()}  # at most MAX_LISTS
    groups = spark.sparkContext.broadcast(_groups(sizes, GROUP_ROWS, MIN_GROUPS))
    # A vector stands in at most ``copies`` lists, so these hold enough of them.
    least = copies * (top + 1)
    # One search for each distinct query vector.
    rep_of = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    blocks = max(1, -(-rep_of.count() // QUERY_BLOCK))

    def post(batches):
        for pdf in batches:
            row, lists = model.value.home(np.stack(pdf["v"].map(np.asarray).tolist()), boundary_ratio, copies)
            rep = pdf["rep"].to_numpy()[row]
            held = groups.value
            group = np.array([held[x][r % len(held[x])] for x, r in zip(lists.tolist(), rep.tolist(), strict=True)], np.int64)
            # A vector in several lists of a group is sent there once.
            sent = pd.DataFrame({"group": group, "rep": rep, "row": row, "list": lists}).groupby(["group", "rep", "row"], sort=False)["list"].agg(list).reset_index()
            vecs = pdf["v"].to_numpy()
            yield pd.DataFrame({"group": sent["group"], "id": sent["rep"], "v": [vecs[i] for i in sent["row"]], "lists": sent["list"]})

    def ask(batches):
        for pdf in batches:
            rows = []
            for q, v in zip(pdf["q"].tolist(), pdf["v"], strict=True):
                by_group: dict[int, list[int]] = {}
                for x in model.value.search(np.asarray(v, float), search_ratio, sizes, least).tolist():
                    for g in groups.value.get(x, ()):
                        by_group.setdefault(g, []).append(x)
                rows += [(g, q, v, xs) for g, xs in by_group.items()]
            yield pd.DataFrame(rows, columns=["group", "id", "v", "lists"])

    kind = "group long, id long, v array<double>, lists array<int>"
    stored = entries.select("rep", "v").mapInPandas(post, kind).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = rep_of.select("q", "v").mapInPandas(ask, kind).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def search(stored_pdf: pd.DataFrame, wanted_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(stored_pdf) or not len(wanted_pdf):
            return pd.DataFrame({"q": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)})
        stored_pdf = stored_pdf.sort_values("id", kind="stable")
        v, rep = np.stack(stored_pdf["v"].map(np.asarray).tolist()), stored_pdf["id"].to_numpy()
        names, number = np.unique(np.concatenate(stored_pdf["lists"].tolist()), return_inverse=True)
        member = np.zeros((len(v), len(names)), bool)
        member[np.repeat(np.arange(len(v)), stored_pdf["lists"].map(len)), number] = True
        member = member.T.astype(np.float32)
        longest = float(np.sqrt((v * v).sum(axis=1).max()))
        place = {x: i for i, x in enumerate(names.tolist())}
        parts = []
        for a in range(0, len(wanted_pdf), 256):
            some = wanted_pdf.iloc[a:a + 256]
            q = np.stack(some["v"].map(np.asarray).tolist())
            reads = np.zeros((len(q), len(names)), np.float32)
            for i, xs in enumerate(some["lists"]):
                reads[i, [place[x] for x in xs if x in place]] = 1
            scores = np.where(reads @ member > 0, q @ v.T, -np.inf)
            # All that rounding could lift to the last place; then cut exactly.
            k = min(scores.shape[1], top + 1)
            last = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
            margin = 1e-9 * np.sqrt((q * q).sum(axis=1, keepdims=True)) * longest
            row, at = np.nonzero((scores >= last - margin) & (scores > -np.inf))
            score = np.concatenate([np.empty(0), *((q[row[i:i + 50_000]] * v[at[i:i + 50_000]]).sum(axis=1) for i in range(0, len(row), 50_000))])
            order = np.lexsort((rep[at], -score, row))
            first = np.searchsorted(row, np.arange(len(q)))
            best = order[np.arange(len(row)) - first[row[order]] < top + 1]
            parts.append(pd.DataFrame({"q": some["id"].to_numpy()[row[best]], "rep": rep[at[best]], "score": score[best]}))
        return pd.concat(parts)

    met = wanted.groupBy("group", "block").cogroup(stored.groupBy("group", "block")).applyInPandas(
        lambda w, s: search(s, w), "q long, rep long, score double")
    # The same vector may come from several groups.
    met = met.groupBy("q", "rep").agg(F.max("score").alias("score"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    met = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1)
    listed = met.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1).select("q", "score", "vec_id")
    pairs = asked.join(rep_of, "v").select(F.col("vec_id").alias("query_id"), "q").distinct().join(listed, "q").where("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
