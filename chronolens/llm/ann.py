"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``Settings.sample``); every row is filed
in one of its leaves by going down to the nearest centre. A query keeps a
priority queue of nodes by distance to their centres: it opens the nearest,
queues its children, and visits leaves in the order they come up. How many
leaves are visited is calibrated: for some queries the exact neighbours among all
rows are found by brute force, and visits are widened until the mean recall over
them reaches ``Settings.recall``.

The tree and the leaves' sizes are bounded by the settings, whatever the rows. A
leaf with more rows than ``Settings.block`` is dealt into blocks by a hash of the
id. Each row moves once, to its block; a query goes to the blocks of the leaves it
visits. A task holds one block's rows at a time and reads the queries past them, however many they are.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do rows without id; repeated ids count once; unequal lengths count as padded
with zeros. Ties go to the smaller id. A distance too large for a double is infinite and comes last. With fewer than k candidates all leaves
are visited and all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, usable, width_of


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    branch: int = 8
    leaf_rows: int = 256
    leaves: int = 4_096
    queries: int = 128
    recall: float = 0.97
    block: int = 16_384


class Tree:
    """Nodes with centres; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        self.width = sample.shape[1]
        self._grow(sample, leaves, branch)

    def _node(self) -> int:
        self.children.append([])
        self.centres.append(np.zeros((0, self.width)))
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def _grow(self, x: np.ndarray, leaves: int, branch: int) -> int:
        me = self._node()
        parts = min(branch, leaves)
        if parts < 2 or len(x) < 2 * parts:
            return self._end(me)
        centres, own = self._cluster(x, parts)
        kept = [c for c in range(len(centres)) if (own == c).any()]
        if len(kept) < 2:
            return self._end(me)
        kids = []
        for c in kept:
            mine = x[own == c]
            kids.append(self._grow(mine, max(1, round(leaves * len(mine) / len(x))), branch))
        self.centres[me], self.children[me] = centres[kept], kids
        return me

    def _end(self, me: int) -> int:
        self.leaf[me] = self.n_leaves
        self.n_leaves += 1
        return me

    def _cluster(self, x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        centres = x[self.rng.choice(len(x), parts, replace=False)]
        for _ in range(12):
            own = _nearest(x, centres)
            new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(parts)])
            if np.allclose(new, centres):
                break
            centres = new
        return centres, _nearest(x, centres)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = _nearest(x[rows], self.centres[node])
            open_ += [(kid, rows[own == c]) for c, kid in enumerate(self.children[node]) if (own == c).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            d = ((self.centres[node] - q) ** 2).sum(1)
            for far, kid in zip(d.tolist(), self.children[node]):
                heapq.heappush(queue, (far, kid))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _closest(ids: np.ndarray, v: np.ndarray, qids: list[int], q: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, itself left out: products narrow the rows down, differences decide."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        size = (v * v).sum(1)
        for lo in range(0, len(qids), 64):
            x = q[lo : lo + 64]
            rough = size + (x * x).sum(1)[:, None] - 2 * (x @ v.T)
            # what the product may be off by
            slack = 1e-12 * v.shape[1] * (size.max(initial=0) + (x * x).sum(1)) + 1e-300
            for qid, y, r, e in zip(qids[lo : lo + 64], x, rough, slack):
                if len(r) > k + 1 and np.isfinite(r).all():
                    some = np.flatnonzero(r <= np.partition(r, k)[k] + 2 * e)
                else:
                    some = np.arange(len(r))
                some = some[ids[some] != qid]
                d = np.sqrt(((v[some] - y) ** 2).sum(1))
                top = np.lexsort((ids[some], d))[:k]
                out.append((np.full(len(top), qid, np.int64), ids[some[top]], d[top]))
    qs, vs, ds = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return pd.DataFrame({"query_id": qs, "vec_id": vs, "score": ds})


def exact(data: DataFrame, qids: list[int], q: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of a bounded set of queries among all rows of ``data`` (vec_id, v), by brute force."""

    def run(batches):
        for b in batches:
            width = max(width_of(b["v"]), q.shape[1])
            yield _closest(b["vec_id"].to_numpy(), matrix(b["v"], width), qids, np.pad(q, ((0, 0), (0, width - q.shape[1]))), k)

    near = data.mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).toPandas()


def _hash(column: str, seed: int):
    return F.xxhash64(F.col(column), F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k nearest found."""
    s, spark = settings, rows.sparkSession
    data = written(usable(rows, nonzero=True), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    asked = data.where(F.col("vec_id") % every == 0)
    total, n_asked = data.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    sample = data.where(_hash("vec_id", 1) < min(1.0, s.sample / total)).toPandas().sort_values("vec_id")
    some = asked.where(_hash("vec_id", 2) < min(1.0, s.queries / n_asked)).toPandas().sort_values("vec_id")
    width = width_of(sample["v"], some["v"]) or 1
    tree = Tree(matrix(sample["v"], width), max(1, min(s.leaves, total // s.leaf_rows)), s.branch)
    visits = _calibrated(data, tree, some, width, k, s)

    def cut(v: np.ndarray) -> np.ndarray:
        return matrix([x[:width] for x in v], width)

    def file(batches):
        for b in batches:
            yield b.assign(leaf=tree.file(cut(b["v"])))

    def route(batches):
        for b in batches:
            yield b.assign(leaves=[tree.visits(x, visits) for x in cut(b["v"])])

    filed = written(data.mapInPandas(file, "vec_id long, v array<double>, leaf long"), "filed")
    # a row a leaf: at most Settings.leaves of them
    parts = F.broadcast(filed.groupBy("leaf").agg(F.ceil(F.count("*") / s.block).cast("int").alias("parts")))
    left = filed.join(parts, "leaf").select("leaf", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)").alias("p"), F.lit(False).alias("asked"), "vec_id", "v")
    routed = asked.mapInPandas(route, "vec_id long, v array<double>, leaves array<long>")
    right = routed.select("vec_id", "v", F.explode("leaves").alias("leaf")).join(parts, "leaf").select("leaf", F.explode(F.expr("sequence(0, parts - 1)")).alias("p"), F.lit(True).alias("asked"), "vec_id", "v")

    def search(batches):
        key, ids, held = None, [], []
        for b in batches:
            edges = np.flatnonzero((b["leaf"].diff() != 0) | (b["p"].diff() != 0) | (b["asked"] != b["asked"].shift()))
            for lo, hi in zip(edges, [*edges[1:], len(b)]):
                some = b.iloc[lo:hi]
                if (some["leaf"].iloc[0], some["p"].iloc[0]) != key:
                    key, ids, held = (some["leaf"].iloc[0], some["p"].iloc[0]), [], []
                if not some["asked"].iloc[0]:
                    ids.append(some["vec_id"].to_numpy())
                    held.append(some["v"])
                elif held:
                    w = width_of(*held, some["v"])
                    if not (len(held) == 1 and isinstance(held[0], np.ndarray) and held[0].shape[1] == w):
                        ids, held = [np.concatenate(ids)], [np.concatenate([matrix(x, w) for x in held])]
                    yield _closest(ids[0], held[0], some["vec_id"].tolist(), matrix(some["v"], w), k)

    near = left.unionByName(right).repartition("leaf", "p").sortWithinPartitions("leaf", "p", "asked").mapInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(data: DataFrame, tree: Tree, some: pd.DataFrame, width: int, k: int, s: Settings) -> int:
    """Leaves to visit: the fewest that find ``s.recall`` of the exact neighbours of the calibration queries."""
    if some.empty or tree.n_leaves == 1:
        return tree.n_leaves
    q = matrix(some["v"], width)
    true = exact(data, some["vec_id"].tolist(), q, k)
    ids = true["vec_id"].drop_duplicates()
    small = data.sparkSession.createDataFrame(pd.DataFrame({"vec_id": ids}), "vec_id long")
    found = data.join(F.broadcast(small), "vec_id").toPandas()
    leaf = dict(zip(found["vec_id"].tolist(), tree.file(matrix([v[:width] for v in found["v"]], width)).tolist()))
    place = {qid: {x: n for n, x in enumerate(tree.visits(v, tree.n_leaves))} for qid, v in zip(some["vec_id"].tolist(), q)}
    need = sorted(place[a][leaf[b]] + 1 for a, b in zip(true["query_id"].tolist(), true["vec_id"].tolist()))
    # fewer than k candidates: all of them are wanted
    if len(true) < k * len(some) or not need:
        return tree.n_leaves
    return need[min(len(need) - 1, math.ceil(s.recall * len(need)) - 1)]
