"""Related-document packing.

A nearest-neighbour graph is made over the whole table: texts of equal sets of
five-word shingles are one item; items that share any of ``WAYS`` min-hashes of
the set meet, and each keeps its ``NEIGHBOURS`` nearest by the min-hashes they
share. Two items of likeness s meet with probability 1 - (1 - s)^16: 0.97 at 0.2.
Items that share a min-hash of more than ``HOT`` items meet by every two such min-hashes
they share, and the least items of each fill the places that nothing nearer takes. Where two such
are shared by more than ``HOT`` items, all of these meet each other block by block, at
a cost that grows as the square of their number: no pair is left out. Min-hashes are compared by 16 bits each, of
which two that differ agree once in 65,536 times.

Each item hangs together with its nearest one, and what hangs together with the
nearest of the others; in the order of all, such groups stand together, those that
share words (least hash over the words, then over the shingles) near each other. The
order is cut into ranges of ``RANGE`` characters, whatever the session's number of
partitions; a text's place in its item
is by its hash, so no range grows with a hot group or with long texts, which are
placed like any other. A range is read in blocks of
bounded size that end with a group where they can. In a block the graph's
links come first, and after them those by token counts; paths are walked through
it: start at the unvisited document
of lowest degree, go on to the nearest unvisited neighbour, start again where
there is none (the greedy walk of in-context pretraining, Shi et al. 2023).
Windows are filled along the paths one after another, cut freely, so that only
the last window of a range has padding.

A document's ids are those of the tokenizer file with id 1 after them. Null and
empty texts have id 1 alone. Texts of any length are packed whole, over as many
windows as they need. Repeated rows are packed as often as they occur. Null ids
are kept; columns beyond doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, released, written
from .components import components
from .near_copies import _runs
from .shingling import band_keys, lists, min_hashes, shingle_sets, sliced

SIZE = 2048
END = 1
#: a block closes at so many documents or tokens
BLOCK_DOCS = 512
BLOCK_TOKENS = 4_000_000
NEIGHBOURS = 8
#: min-hashes by which items meet; the most that meet at once
WAYS = 16
HOT = 1_000
BUCKETS = 256
#: characters of a range, which ends with the one window that has padding; the most ranges, so that one task list holds them
RANGE = 8_000_000
MOST_RANGES = 1 << 15
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def _fast(path: str):
    """The file's encoding in the faster of the two libraries, if its ids follow its merges; else None."""
    import tiktoken

    from .bpe_automaton import PRESPLIT, _byte_alphabet

    spec = json.load(open(path, encoding="utf-8"))
    vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    ranks = {bytes(alphabet[c] for c in s): i for s, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=PRESPLIT, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in spec["added_tokens"]})


def encode(path: str, text: str | None) -> np.ndarray:
    """Ids of a text with the closing id."""
    if not text:
        return np.array([END], np.uint32)
    fast = _fast(path)
    if fast is not None:
        try:
            return np.append(fast.encode_to_numpy(text, allowed_special="all"), np.uint32(END)).astype(np.uint32)
        except BaseException as e:  # the library gives up on some very long runs of blanks, with an error of its own kind
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    from .bpe_automaton import Encoder

    parts = Encoder(path, bytes).parts([text])[0]
    return np.append(np.frombuffer(b"".join(parts), np.uint32), np.uint32(END)).astype(np.uint32)


def graph(ids: list[np.ndarray]) -> list[dict[int, float]]:
    """Each document's nearest neighbours in the block, both ways, with their similarity."""
    n = len(ids)
    owner = np.repeat(np.arange(n), [len(i) for i in ids])
    flat = np.concatenate(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.bincount(owner * BUCKETS + (flat >> np.uint64(56)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    v = np.sqrt(count) * np.log((n + 1) / (1 + (count > 0).sum(0))).clip(0.01)
    v -= v.mean(0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    k = min(NEIGHBOURS, n - 1)
    out: list[dict[int, float]] = [{} for _ in range(n)]
    if k:
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        for a, row in enumerate(near.tolist()):
            for b in row:
                out[a][b] = out[b][a] = float(sim[a, b])
    return out


def linked(block: list[tuple]) -> list[dict[int, float]]:
    """The links of a block of (doc_id, ids, item, root, near, share): by token counts, above them those of the whole graph, above them equal items."""
    links, at = graph([x[1] for x in block]), {}
    for i, x in enumerate(block):
        at.setdefault(x[2], []).append(i)
    for same in at.values():
        for a, b in zip(same, same[1:]):
            links[a][b] = links[b][a] = 3.0
    for i, x in enumerate(block):
        for item, share in zip(x[4] or (), x[5] or ()):
            for b in at.get(item, ())[:NEIGHBOURS]:
                links[i][b] = links[b][i] = 1.0 + share
    return links


def walk(links: list[dict[int, float]]) -> list[list[int]]:
    """Greedy paths that visit each document once, each from the lowest degree left."""
    seen, paths = [False] * len(links), []
    for start in sorted(range(len(links)), key=lambda i: (len(links[i]), i)):
        if seen[start]:
            continue
        path, at = [], start
        while at is not None:
            seen[at] = True
            path.append(at)
            at = max(((s, -b) for b, s in links[at].items() if not seen[b]), default=(0, None))[1]
            at = None if at is None else -at
        paths.append(path)
    return paths


class Windows:
    """Fills windows of ``SIZE`` ids one after another."""

    def __init__(self, first_id: int):
        self.sequence, self.at = first_id, 0

    def place(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of one document."""
        start = 0
        while start < len(ids):
            length = min(len(ids) - start, SIZE - self.at)
            yield start, length, self.sequence, self.at
            start += length
            self.at += length
            if self.at == SIZE:
                self.sequence, self.at = self.sequence + 1, 0


def _features(docs: DataFrame) -> DataFrame:
    """key (of id and text), item, bands, sig (16 bits of each min-hash), k1 (least word), k2 (least shingle), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at = 0
            for texts in sliced(batch.column(1).to_pylist()):
                values, count, word = shingle_sets(texts)
                low = min_hashes(values, count, WAYS)
                raw, end = values.tobytes(), np.cumsum(count) * 4
                items = np.array([xxhash.xxh3_64_intdigest(raw[b - 4 * n : b]) for b, n in zip(end.tolist(), count.tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(items.view(np.int64)),
                        lists(band_keys(low, 1).view(np.int64)),
                        pa.array([x.tobytes() for x in (low >> np.uint64(32)).astype("<u2")], pa.binary()),
                        pa.array(word.view(np.int64)),
                        pa.array(low[:, 0].copy().view(np.int64)),
                        pa.array([len(t or "") + 1 for t in texts], pa.int64()),
                    ],
                    names=["key", "item", "bands", "sig", "k1", "k2", "size"],
                )
                at += len(texts)

    return docs.select("key", "text").mapInArrow(run, "key long, item long, bands array<long>, sig binary, k1 long, k2 long, size long")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many min-hashes each signature of ``a`` has in common with each of ``b``."""
    if len(a) * len(b) < 4096:
        return (a[:, None] == b[None]).sum(2, dtype=np.int8)
    out = np.zeros((len(a), len(b)), np.int8)
    for x, y in zip(a.T, b.T):
        out += x[:, None] == y[None]
    return out


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


PAIRS = "a long, b long, share float"


def _in_buckets(rows: DataFrame) -> DataFrame:
    """(a, b, share): the nearest of each item among all rows (key, item, sig) of its key, which fit one task; of ties the least items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _runs(batches, "key", 20_000):
            item, key, sig = whole["item"].to_numpy(), whole["key"].to_numpy(), _sigs(whole["sig"])
            first = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            size = np.diff(first)
            two = first[:-1][size == 2]
            same = (sig[two] == sig[two + 1]).mean(1)
            out = [(item[two], item[two + 1], same), (item[two + 1], item[two], same)]
            for start, n in zip(first[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own, names = sig[start : start + n], item[start : start + n]
                k = min(NEIGHBOURS, n - 1)
                # places break ties: rows are sorted by item
                order = _shared(own, own).astype(np.int32) * n - np.arange(n, dtype=np.int32)
                np.fill_diagonal(order, -(1 << 30))
                best = np.argpartition(-order, k - 1, axis=1)[:, :k]
                out.append((np.repeat(names, k), names[best].ravel(), (np.take_along_axis(order, best, 1) + best).ravel() / (n * WAYS)))
            a, b, share = (np.concatenate(x) for x in zip(*out))
            yield pd.DataFrame({"a": a, "b": b, "share": share.astype(np.float32)})

    return rows.select("key", "item", "sig").repartition("key").sortWithinPartitions("key", "item").mapInPandas(run, PAIRS)


class _Block:
    """The nearest so far of a block of items, while others pass by in the order of items."""

    def __init__(self, key: int):
        self.key, self.rows, self.share = key, [], None

    def meet(self, item: np.ndarray, sig: np.ndarray) -> None:
        if self.share is None:
            self.item, self.sig = (np.concatenate(x) for x in zip(*self.rows))
            self.share, self.near = np.zeros((len(self.item), NEIGHBOURS), np.int8), np.zeros((len(self.item), NEIGHBOURS), np.int64)
        for lo in range(0, len(item), 500):
            b = item[lo : lo + 500]
            share = _shared(self.sig, sig[lo : lo + 500])
            at = np.minimum(np.searchsorted(self.item, b), len(self.item) - 1)
            own = np.flatnonzero(self.item[at] == b)
            share[at[own], own] = 0
            q, c = np.nonzero(share > self.share[:, -1:])
            if not len(q):
                continue
            rows = q[np.append(True, q[1:] != q[:-1])]
            of = np.concatenate([np.repeat(rows, NEIGHBOURS), q])
            more = np.concatenate([self.share[rows].ravel(), share[q, c]])
            near = np.concatenate([self.near[rows].ravel(), b[c]])
            order = np.lexsort((near, -more, of))
            best = order[np.searchsorted(of[order], rows)[:, None] + np.arange(NEIGHBOURS)]
            self.share[rows], self.near[rows] = more[best], near[best]

    def found(self) -> pd.DataFrame:
        some = self.share > 0
        return pd.DataFrame({"a": np.repeat(self.item, some.sum(1)), "b": self.near[some], "share": (self.share[some] / WAYS).astype(np.float32)})


def _met(rows: DataFrame, others: DataFrame, hot: int) -> DataFrame:
    """(a, b, share): the nearest of each of ``rows`` among all ``others`` (key, item, sig) of its key. ``rows`` are dealt into
    blocks of about ``hot``; ``others`` pass by each block, so that a task holds one block whatever the key's size."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("long").alias("blocks"))
    block = F.xxhash64("key", F.pmod(F.xxhash64("item"), F.col("blocks")))
    each = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", j)))
    own = rows.join(blocks, "key").select(block.alias("key"), F.lit(0).alias("passing"), "item", "sig")
    all_ = own.unionByName(others.join(blocks, "key").select(each.alias("key"), F.lit(1).alias("passing"), "item", "sig"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            key, passing, item, sig = x["key"].to_numpy(), x["passing"].to_numpy(), x["item"].to_numpy(), _sigs(x["sig"])
            new = np.append(True, (key[1:] != key[:-1]) | (passing[1:] != passing[:-1]))
            first = np.flatnonzero(new)[: len(key)].tolist()
            for lo, hi in zip(first, [*first[1:], len(key)]):
                if held is None or held.key != key[lo]:
                    if held is not None and held.share is not None:
                        yield held.found()
                    held = _Block(key[lo])
                if not passing[lo]:
                    held.rows.append((item[lo:hi], sig[lo:hi]))
                elif held.rows:  # a block may have been dealt nothing
                    held.meet(item[lo:hi], sig[lo:hi])
        if held is not None and held.share is not None:
            yield held.found()

    return all_.repartition("key").sortWithinPartitions("key", "passing", "item").mapInPandas(run, PAIRS)


def _in_hot(rows: DataFrame, hot: int) -> list[DataFrame]:
    """Tables (a, b, share) that hold the nearest of each item among all rows (key, item, sig) of keys that are each too large for one task.

    Items that share two of these keys or more meet in a bucket of the two. Those that share just one are as near as
    any other such pair, so the least few items of a key serve all of it: a place that nothing nearer
    takes falls to them. Where the bucket of two is too large as well, all its items meet, block by block; buckets
    that overlap are made one group where that takes fewer comparisons.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy("item"))
    few = rows.withColumn("place", place).where(F.col("place") <= NEIGHBOURS + 1).drop("place")
    out = [written(_met(rows, few, hot), "hot-near")]
    several = rows.groupBy("item").agg(F.first("sig").alias("sig"), F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    twos = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.lit(WAYS)), lambda y: F.xxhash64(x, y))))
    two = written(several.select("item", "sig", F.explode(twos).alias("key")), "hot-pairs")
    count = written(two.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "hot-counts")
    out.append(written(_in_buckets(two.join(count.where(F.col("n") <= hot), "key")), "hot-near"))
    large = count.where(F.col("n") > hot)
    if large.limit(1).count():
        rest = written(two.join(large, "key"), "hot-rest")
        roots = components(rest.select(F.col("item").alias("a"), "key").join(rest.groupBy("key").agg(F.min("item").alias("b")), "key").select("a", "b"), "hot-groups")
        of = written(rest.join(roots, F.col("item") == F.col("node")).select("key", "item", "sig", "n", "root"), "hot-rooted")
        each = of.groupBy("root", "key").agg(F.first("n").alias("n")).groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("each"))
        whole = of.select("root", "item").distinct().groupBy("root").agg(F.count("*").cast("double").alias("n")).select("root", (F.col("n") * F.col("n")).alias("whole"))
        group = F.when(F.col("whole") <= F.col("each"), F.xxhash64("root", F.lit(0))).otherwise(F.xxhash64("key", F.lit(1)))
        groups = written(of.join(each, "root").join(whole, "root").select(group.alias("key"), "item", "sig").distinct(), "hot-grouped")
        out.append(written(_met(groups, groups, hot), "hot-near"))
        for t in (rest, roots, of, groups):
            dropped(t)
    dropped(two)
    dropped(count)
    return out


def _nearest(items: DataFrame, hot: int = HOT) -> DataFrame:
    """(item, near, share): the nearest other items of each, nearest first, among all that share a min-hash with it; of ties the least items."""
    rows = items.select("item", "sig", F.explode("bands").alias("key"))
    count = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    pairs = _in_buckets(rows.join(count.where(F.col("n") <= hot), "key"))
    large = written(count.where(F.col("n") > hot), "hot-min-hashes")
    tables = []
    if large.limit(1).count():
        hot_rows = written(rows.join(large, "key").select("key", "item", "sig"), "hot-items")
        tables = [*_in_hot(hot_rows, hot), hot_rows]
        pairs = reduce(DataFrame.unionByName, tables[:-1], pairs)
    near = pairs.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("share")).alias("s"), F.col("b").alias("b")))), 1, NEIGHBOURS).alias("x"))
    out = written(near.select(F.col("a").alias("item"), F.col("x.b").alias("near"), F.transform("x.s", lambda s: -s).alias("share")), "near")
    for t in (large, *tables):
        dropped(t)
    return out


def _grouped(near: DataFrame) -> DataFrame:
    """(item, r1, r2) of the items with neighbours: groups of nearest ones, and groups of those by their nearest links."""
    r1 = written(components(near.select(F.col("item").alias("a"), F.col("near")[0].alias("b")), "nearest"), "groups").withColumnRenamed("node", "item")
    links = near.select("item", F.explode(F.arrays_zip("near", "share")).alias("x")).select("item", F.col("x.near").alias("b"), F.col("x.share").alias("share"))
    links = links.join(r1.select("item", F.col("root").alias("ra")), "item").join(r1.select(F.col("item").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
    best = links.groupBy("ra").agg(F.max(F.struct("share", "rb")).alias("x"))
    r2 = components(best.select(F.col("ra").alias("a"), F.col("x.rb").alias("b")), "groups-of-groups")
    return r1.join(r2, r1["root"] == r2["node"], "left").select("item", r1["root"].alias("r1"), F.coalesce(r2["root"], r1["root"]).alias("r2"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(key, item, root, at, range) with the place ``at`` in characters, one row a key; (item, near, share); the number of ranges."""
    features = written(_features(_keyed(docs)), "features")
    items = features.groupBy("item").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    near = _nearest(items)
    released(docs.sparkSession)
    of = written(features.groupBy("item").agg(F.sum("size").alias("size"), F.min(F.struct("k1", "k2")).alias("k")).join(_grouped(near), "item", "left").select("item", "size", "k", F.coalesce("r1", "item").alias("r1"), F.coalesce("r2", "item").alias("r2")), "items")
    released(docs.sparkSession)
    place = of.groupBy("r2").agg(F.min("k").alias("k"))
    order = ["k1", "k2", "r2", "r1", "item"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = of.drop("k").join(place, "r2").select("k.k1", "k.k2", "r2", "r1", "item", "size").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            end = at + b["size"].cumsum()
            yield pd.DataFrame({"part": part, "item": b["item"], "root": b["r2"], "at": end - b["size"], "size": b["size"]})
            at = int(end.iloc[-1]) if len(b) else at

    run_at = written(sized.mapInPandas(run, "part int, item long, root long, at long, size long"), "places")
    sums = {r["part"]: r["n"] for r in run_at.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE)))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("part")) if base else F.lit(0)
    share = F.xxhash64("key", F.lit(1)).bitwiseAND((1 << 31) - 1) / float(1 << 31)
    at = (first + F.col("at") + F.floor(share * F.col("size"))).cast("long")
    keys = features.select("key", "item").distinct().join(run_at, "item").select("key", "item", "root", at.alias("at"))
    # divided before it is multiplied: places times ranges would pass what a long holds
    return keys.withColumn("range", F.least(F.floor(F.col("at") / (max(1, total) / ranges)), F.lit(ranges - 1)).cast("int")), near, ranges


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, item, root, near, share: documents in ranges of equal size, sorted so that related ones are near."""
    keys, near, n = _placed(docs)
    keys = written(keys.join(near, "item", "left"), "ordered")
    released(docs.sparkSession)
    out = _keyed(docs).select("doc_id", "text", "key").join(keys.hint("merge"), "key").drop("key")
    return out.repartitionById(n, F.col("range")).sortWithinPartitions("at", "item", "doc_id").select("doc_id", "text", "item", "root", "near", "share")


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[list[tuple]]:
    """Lists of (doc_id, ids, item, root, near, share)."""
    held, tokens = [], 0
    for batch in batches:
        for doc, text, *rest in zip(*batch.columns):
            rest = [x.as_py() for x in rest]
            if held and (len(held) >= BLOCK_DOCS and rest[1] != held[-1][3] or len(held) >= 2 * BLOCK_DOCS):
                yield held
                held, tokens = [], 0
            ids = encode(path, text.as_py())
            held.append((doc.as_py(), ids, *rest))
            tokens += len(ids)
            if tokens >= BLOCK_TOKENS:
                yield held
                held, tokens = [], 0
    if held:
        yield held


def _pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[list[tuple]]:
    """Pieces of a range in the order of the windows, a list a block, with the piece's ids last."""
    windows = Windows(TaskContext.get().partitionId() << 40)
    for block in _blocks(batches, path):
        out = []
        for way in walk(linked(block)):
            for i in way:
                doc, ids = block[i][:2]
                for start, length, sequence, offset in windows.place(ids):
                    part = ids[start : start + length]
                    out.append((doc, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset, part))
        yield out


def packed_pieces(docs: DataFrame, path: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. One shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _pieces(batches, path):
            cols = list(zip(*out))[:7]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return _ordered(docs).mapInArrow(run, SCHEMA)


def packed_sequences(docs: DataFrame, path: str, pad: int = 0) -> DataFrame:
    """A row per sequence: sequence_id, ids (padded with ``pad`` unless their number is a power of two), doc_ids by piece, starts of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(pieces: list[tuple]) -> dict:
            ids = np.concatenate([p[7] for p in pieces])
            if len(ids) & (len(ids) - 1):
                ids = np.append(ids, np.full(SIZE - len(ids), pad, np.uint32))
            return {"sequence_id": pieces[0][5], "ids": ids.tolist(), "doc_ids": [p[0] for p in pieces], "offsets": [p[6] for p in pieces]}

        schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])
        held: list[tuple] = []
        for out in _pieces(batches, path):
            rows = []
            for p in out:
                if held and held[0][5] != p[5]:
                    rows.append(row(held))
                    held = []
                held.append(p)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row(held)], schema)

    return _ordered(docs).mapInArrow(run, "sequence_id long, ids array<int>, doc_ids array<long>, offsets array<long>")
