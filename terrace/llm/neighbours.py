"""Approximate nearest neighbours by collision counting.

Vectors are projected on random directions, as many as they have dimensions and
``PROJECTIONS`` at least: the more dimensions, the less the nearest differ from the others in distance. In a block of vectors each
direction has its own array sorted by projection. A query widens a window around its
own projection in every array, level by level (virtual rehashing), and counts for each
vector in how many windows it lies. Vectors that reach the collision threshold are
verified by the exact inner product; widening stops when enough of the block has been
verified. Largest inner product becomes nearest distance by one added coordinate, in
ranges of similar length, so that long vectors do not squeeze the others together.

Blocks of vectors and groups of queries meet in a grid of tasks of bounded size; each
sends on the best of its block, and these are ranked per query.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Directions at least; vectors of more dimensions have as many as dimensions.
PROJECTIONS = 64
#: Part of the directions in which a vector must collide to be verified.
THRESHOLD = 0.6
#: Widening stops once ``k`` plus this part of the block has reached the threshold.
VERIFIED_SHARE = 0.25
FIRST_WIDTH, WIDENING = 0.85, 1.2
#: A range of vectors is searched by itself; its lengths differ by this factor at most.
LENGTH_RATIO = 1.15
BLOCK_ROWS = 8192
GROUP_QUERIES = 16384
SEED = 20


class BlockIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray):
        projected = np.ascontiguousarray((vectors.astype(np.float32) @ directions).T)
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.n = len(vectors)

    def windows(self, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window in each array, as (query, direction)."""
        sides = [(s.searchsorted(q - width), s.searchsorted(q + width, "right")) for s, q in zip(self.sorted, queries.T)]
        low, high = (np.array(x).T for x in zip(*sides))
        return low, high

    def candidates(self, queries: np.ndarray, enough: int, need: int):
        """For each query in turn, the rows that collide with it in at least ``need`` directions.

        Windows widen until ``enough`` rows do, or all rows lie in all windows.
        """
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        m = len(self.sorted)
        for i in range(len(queries)):
            counts, level, low, high = np.zeros(self.n, np.int64), 0, None, None
            while True:
                if level == len(levels):
                    levels.append(self.windows(queries, FIRST_WIDTH * WIDENING**level))
                new_low, new_high = (x[i].tolist() for x in levels[level])
                if low is None:
                    parts = [row[a:b] for row, a, b in zip(self.order, new_low, new_high)]
                else:  # only what the wider windows add
                    parts = [row[a:b] for row, a, b in zip(self.order, new_low, low)] + [row[a:b] for row, a, b in zip(self.order, high, new_high)]
                counts += np.bincount(np.concatenate(parts), minlength=self.n)
                found = np.flatnonzero(counts >= need)
                if len(found) >= enough or sum(new_high) - sum(new_low) == m * self.n:
                    yield found
                    break
                low, high, level = new_low, new_high, level + 1


def _directions(dim: int) -> np.ndarray:
    """Directions for vectors of ``dim`` dimensions and the one that lifting adds."""
    return np.random.default_rng(SEED).standard_normal((dim + 1, max(PROJECTIONS, dim))).astype(np.float32)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled by the longest and given the coordinate that makes them unit vectors: nearest is then largest inner product."""
    scaled = vectors / longest
    return np.c_[scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))]


def length_ranges(lengths: np.ndarray) -> list[np.ndarray]:
    """Rows by falling length, cut where they get shorter than a range's longest by more than ``LENGTH_RATIO``."""
    order, out = np.argsort(-lengths, kind="stable"), []
    while len(order):
        n = int(np.count_nonzero(lengths[order] * LENGTH_RATIO >= lengths[order[0]]))
        out.append(order[:n])
        order = order[n:]
    return out


def search_block(queries, query_ids, vectors, ids, k: int, share: float = VERIFIED_SHARE):
    """``(query_id, vec_id, score)`` arrays: up to ``k`` best of this block for each query, none the query's own id.

    Vectors are searched by ranges of length, the longest first, each lifted by its own
    longest vector. A query leaves out a range that is too short to hold a better one
    than the ``k`` it has.
    """
    directions = _directions(queries.shape[1])
    norms = np.linalg.norm(queries, axis=1)
    projected = np.c_[queries / norms[:, None], np.zeros(len(queries))].astype(np.float32) @ directions
    lengths, need = np.linalg.norm(vectors, axis=1), int(np.ceil(THRESHOLD * directions.shape[1]))
    best = [(np.zeros(0, ids.dtype), np.zeros(0)) for _ in queries]
    worst = np.full(len(queries), -np.inf)
    for part in length_ranges(lengths):
        longest = float(lengths[part[0]]) * (1 + 1e-12)
        asking = np.flatnonzero(worst <= norms * longest * (1 + 1e-9))
        if not len(asking):
            continue
        part = np.sort(part)
        enough = int(k + 1 + share * len(part))
        if 2 * enough >= len(part):  # searching would take longer than verifying all
            found = repeat(np.arange(len(part)))
        else:
            found = BlockIndex(_lifted(vectors[part], longest), directions).candidates(projected[asking], enough, need)
        for i, rows in zip(asking.tolist(), found):
            rows = part[rows]
            rows = rows[ids[rows] != query_ids[i]]
            near = vectors[rows]
            rough = near @ queries[i]
            if len(rows) > k:  # the product above may round copies of a vector differently
                keep = rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9 * longest * np.abs(queries[i]).sum()
                rows, near = rows[keep], near[keep]
            all_ids = np.concatenate([best[i][0], ids[rows]])
            scores = np.concatenate([best[i][1], (near * queries[i]).sum(axis=1)])
            first = np.lexsort((all_ids, -scores))[:k]
            best[i] = all_ids[first], scores[first]
            if len(first) == k:
                worst[i] = scores[first[-1]]
    if not best:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(query_ids, [len(x) for x, _ in best]), *(np.concatenate(x) for x in zip(*best))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.flatten()).astype(np.float64).reshape(len(rows), -1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    block_rows: int = BLOCK_ROWS,
    group_queries: int = GROUP_QUERIES,
    share: float = VERIFIED_SHARE,
) -> DataFrame:
    """For each of ``queries`` the ``k`` rows of ``vectors`` of largest inner product that are found.

    Both have ``vec_id`` and ``embedding``. Returns ``query_id, rank, vec_id, score``:
    the exact inner product in double precision, largest first, ties to the smaller
    ``vec_id``; a query's own ``vec_id`` is left out. Recall depends on ``share``.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite
    components, and rows without ``vec_id``, take no part; of rows with one
    ``vec_id`` the smallest vector counts; vectors meet only those of their own
    length; with fewer than ``k`` others all come back; an empty table gives an empty
    result; other columns are ignored.
    """

    def usable(df: DataFrame) -> DataFrame:
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        kept = df.where(F.col("vec_id").isNotNull() & whole).select("vec_id", "embedding", norm.alias("norm")).where("norm > 0")
        return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.min_by("norm", "embedding").alias("norm"))

    data, asked = usable(vectors), usable(queries)
    # Of equal vectors only the first k + 1 ids can be among the nearest of any query.
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    data = data.withColumn("_copy", copy).where(F.col("_copy") <= k + 1).drop("_copy")
    groups = max(1, -(-asked.count() // group_queries))
    blocks = max(1, -(-data.count() // block_rows))
    # Every vector meets every query group, every query every block.
    dim, near = F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    left = data.select("vec_id", "embedding", dim, near, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group")
    right = asked.select("vec_id", "embedding", dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), mine)
    keys = ("dim", "block", "group")

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if rows.num_rows and wanted.num_rows:
            # In the order of their ids, so that a rerun of the task gives the same.
            rows, wanted = rows.sort_by("vec_id"), wanted.sort_by("vec_id")
            ids, query_ids = (np.asarray(t["vec_id"].combine_chunks()) for t in (rows, wanted))
            found = search_block(_matrix(wanted["embedding"]), query_ids, _matrix(rows["embedding"]), ids, k, share)
        else:
            found = ([], [], [])
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    grid = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    best = grid.applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
