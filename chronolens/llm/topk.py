"""Exact top-k inner products from an impact-ordered index, score at a time.

Components are integers. Rows stay where they are: a task reads its rows in blocks of
bounded size. Queries are sent to all tasks, in rounds of a bounded number each; so the work is rows times
queries, rows move once (to find repeated ids), none is copied, and only each task's best k of each query move. In a
block the postings (dimension, row, component) are kept in segments by
descending quantised impact, the absolute component; a segment holds its postings
of all dimensions, as a dense band, since dense vectors post in every dimension.
Queries take the segments in that order and add them to accumulators. After a
segment a row's score is known up to what its unread postings can add: the
segment's lower bound times the query's components on the row's unread
dimensions. Once the rows that could still be among the best k are few - those
whose upper bound reaches the k-th best lower bound - these alone are scored
exactly; all others are proved out. Where no proof comes, all segments are read. So are blocks
of k + 1 rows or fewer, and components whose sums a double can't hold, scored at once.

On dense vectors this costs more than it saves: a segment of postings in every dimension is a matrix, and
a product with the whole block is one too.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without id; repeated ids count once; vectors of unequal length count as
padded with zeros. Zero vectors are rows like any other. Ties go to the smaller
id. Fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import usable

#: components of a block's rows, and of a round's queries; a block's segments take about 48 bytes each
CELLS = 1 << 20
#: share of the postings that is read after each segment
SEGMENTS = (0.5, 0.75, 0.9, 1.0)
#: queries that share a pass over the segments
TOGETHER = 64
SCHEMA = "query_id long, vec_id long, score long"


class ImpactIndex:
    """Segments of one block, by descending impact."""

    def __init__(self, values: np.ndarray):
        self.values = values
        size = np.abs(values)
        self.most = int(size.max(initial=0))
        #: (band of components, which postings are read by then, least impact read)
        self.segments: list[tuple[np.ndarray, np.ndarray, int]] = []
        above = self.most + 1
        for share in SEGMENTS:
            least = 0 if share == 1 or not size.size else int(np.quantile(size, 1 - share))
            if least < above:
                read = size >= least
                self.segments.append((np.where(read & (size < above), values, 0).astype(float), read.astype(np.float32), least))
                above = least

    def best(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows, with exact scores, that hold the k best and all that tie with the k-th; row ``skip[i]`` is left out (-1: none)."""
        n, out = len(self.values), []
        # sums must be exact in double precision
        sure = n > k + 1 and self.most * int(np.abs(queries).max(initial=0)) * queries.shape[1] < 1 << 52
        for lo in range(0, len(queries), TOGETHER):
            q, left = queries[lo : lo + TOGETHER], np.arange(min(TOGETHER, len(queries) - lo))
            some: list[np.ndarray] = [np.arange(n)] * len(left)
            score, weight = np.zeros((len(left), n)), np.abs(q).astype(np.float32)
            for band, read, least in self.segments if sure else []:
                score[left] += q[left].astype(float) @ band.T
                # single precision may round down: a little more is allowed for
                slack = (least * (weight[left].sum(1, keepdims=True) - weight[left] @ read.T)).clip(0) * 1.001 + (least > 0)
                still = []
                for i, row in enumerate(left):
                    floor = np.partition(score[row] - slack[i], n - k - 1)[n - k - 1]
                    some[row] = np.flatnonzero(score[row] + slack[i] >= floor)
                    if len(some[row]) > max(8 * k, n // 50):
                        still.append(row)
                left = np.array(still, np.int64)
                if not len(left):
                    break
            for i, rows in enumerate(some):
                rows = rows[rows != skip[lo + i]]
                out.append((rows, self.values[rows] @ q[i]))
        return out


def integers(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component."""
    return usable(rows, nonzero=False).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _best(qs: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, qs))
    qs, ids, score = qs[order], ids[order], score[order]
    first = np.flatnonzero(np.append(True, qs[1:] != qs[:-1])) if len(qs) else np.zeros(0, np.int64)
    keep = np.arange(len(qs)) - np.repeat(first, np.diff(np.append(first, len(qs)))) < k
    return qs[keep], ids[keep], score[keep]


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows."""
    spark = rows.sparkSession
    data = written(integers(rows, scale), "impacts")
    asked = data.where(F.col("vec_id") % every == 0)
    n, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rounds = math.ceil(n * max(1, wide) / CELLS)
    near: list[DataFrame] = []
    for i in range(rounds):
        some = asked.where(F.expr(f"pmod(xxhash64(vec_id), {rounds}) = {i}")).toArrow()
        if not some.num_rows:
            continue
        found = data.mapInArrow(_searcher(spark.sparkContext.broadcast((some["vec_id"].to_numpy(), _matrix(some["v"].combine_chunks(), wide))), k), SCHEMA)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        near.append(written(out, "round") if rounds > 1 else out)
    return reduce(DataFrame.unionByName, near)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows; shorter ones count as followed by zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if (size == width).all():
        return values.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def _searcher(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qs = queries.value
        # the place of each query's own row, by id
        order = np.argsort(qids)
        best = (np.zeros(0, np.int64),) * 3
        held: list[pa.RecordBatch] = []

        def search() -> None:
            nonlocal best
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            wide = max(qs.shape[1], max(np.diff(b.column(1).offsets.to_numpy()).max(initial=0) for b in held))
            values = np.concatenate([_matrix(b.column(1), wide) for b in held])
            own = np.full(len(qids), -1)
            at = np.searchsorted(qids, ids, sorter=order)
            at = order[np.minimum(at, len(order) - 1)]
            mine = qids[at] == ids
            own[at[mine]] = np.flatnonzero(mine)
            index = ImpactIndex(values)
            # a query's first k are held against the next block's
            for lo in range(0, len(qids), 1024):
                found = index.best(np.pad(qs[lo : lo + 1024], ((0, 0), (0, wide - qs.shape[1]))), k, own[lo : lo + 1024])
                q = np.repeat(qids[lo : lo + 1024], [len(r) for r, _ in found])
                r, s = (np.concatenate(x) for x in zip(*found))
                best = tuple(map(np.concatenate, zip(best, _best(q, ids[r], s, k))))
            best = _best(*best, k)
            held.clear()

        n = 0
        for b in batches:
            held.append(b)
            n += len(b.column(1).values)
            if n >= CELLS:
                search()
                n = 0
        if held:
            search()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

    return run
