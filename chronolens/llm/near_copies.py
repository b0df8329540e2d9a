"""Groups of texts whose word shingles are alike to a share of 0.8 or more, exactly.

A 64-bit fingerprint at three bits finds few pairs near that share, so pairs are
looked for by min-hashes of the shingles and decided by the shingles themselves:
  * equal sets of shingles are one item;
  * a band is ``ROWS`` min-hashes; items with an equal band meet in its bucket and
    are compared by all min-hashes, eight bits of each. What may be alike is
    joined by one edge an item, never as all pairs. Two items at 0.8 miss every
    one of the 16 bands once in 4,600 pairs, and the cut of the min-hashes once in 8,400;
  * candidates that hang together meet once more with their shingles, and pairs
    at ``LEAST`` or more are linked. What isn't linked falls apart again;
  * what the bands and the cut have missed is found by prefixes, which miss nothing: under any one
    order of all shingles, two sets at ``LEAST`` share one of the first ``1 - LEAST`` of each, and one more. Shingles
    that a sample finds common come last in the order, so that few sets meet by them. Clusters meet
    where they share such a shingle: items of small meetings by pairs, those of over ``FEW`` block by block. Only what sizes, places
    in the prefixes and sketches leave possible is compared by shingles. A sketch has a bit for the parity of
    the shingles that fall on it, about one bit a shingle: two sketches differ in at most as many bits as shingles are in one set alone,
    so that no pair at ``LEAST`` is ruled out, and the shingles of few others move.
No task holds more than two blocks: ``HOT`` items of a bucket, or ``BLOCK`` candidates or
``BLOCK_BYTES`` of their shingles. A larger bucket or group of candidates is linked within each
block first; then one item of each cluster stands for it, and these are dealt
into blocks anew and linked in turn, for ``ROUNDS`` or for as long as anything is linked. Large
groups of copies are one cluster by then, at a cost in proportion to their rows. Where several clusters are
left, what isn't of the largest meets all items of the group block by block, so that every two items of different
clusters still meet; there rows grow as the group times the rest of it by the block (buckets: as the square of the group by the block).

Words are those of ``shingling``: letters, digits and what is not ASCII, in lower
case. A text of fewer words than a shingle is one shingle, all of it; texts without
words, null ones too, are one item. Repeated rows share an item. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, written
from .components import components
from .shingling import band_keys, lists, min_hashes, parts, shingle_sets, sliced

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 16, 4
HOT = 2_000
#: rounds in which the heads of clusters are linked before all items of the groups that are left meet
ROUNDS = 4
BLOCK = 1_000
BLOCK_BYTES = 8 << 20
#: items that meet by pairs; what the order of shingles is taken from: so many rows, the least shingles of each
FEW = 64
SAMPLE, SAMPLE_BYTES = 10_000, 1 << 12
FEATURES = "item long, bands array<long>, sig binary, shingles binary"


def features(docs: DataFrame, keep: list[str], fingerprints: bool = False) -> DataFrame:
    """The columns ``keep`` (long) of ``docs``, then item, bands (keys), sig (a byte of each min-hash), shingles (32 bits each), on request fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from .simhash import fingerprint

        for batch in batches:
            at = 0
            for texts in sliced(batch.column(0).to_pylist()):
                values, count, _ = shingle_sets(texts, WORDS)
                low = min_hashes(values, count, BANDS * ROWS)
                sets = list(parts(values, count))
                bands, sigs = band_keys(low, ROWS).view(np.int64), (low >> np.uint64(32)).astype(np.uint8)
                cols = [
                    *(c.slice(at, len(texts)) for c in batch.columns[1:]),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)),
                    lists(bands),
                    pa.array([s.tobytes() for s in sigs], pa.binary()),
                    pa.array(sets, pa.binary()),
                ]
                if fingerprints:
                    cols.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [*keep, "item", "bands", "sig", "shingles", *(["fp"] if fingerprints else [])]
    schema = ", ".join([*(f"{c} long" for c in keep), FEATURES, *(["fp long"] if fingerprints else [])])
    return docs.select(F.col("text").cast("string"), *(F.col(c).cast("long") for c in keep)).mapInArrow(run, schema)


def _unions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each is linked with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _runs(batches: Iterator[pd.DataFrame], key: str, most: int) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of a sorted partition."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= most:
            whole = pd.concat(held, ignore_index=True)
            tail = whole[key].to_numpy() == whole[key].iloc[-1]
            if not tail.all():
                yield whole[~tail]
            held, n = [whole[tail]], int(tail.sum()) if not tail.all() else 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _alike(sig: np.ndarray, least: float) -> np.ndarray:
    """The least index that each is linked with by pairs whose min-hashes agree in ``least`` of all. Pairs aren't kept."""
    label = np.arange(len(sig))
    for lo in range(0, len(sig), 64):
        same = (sig[lo : lo + 64, None] == sig[None, lo:]).mean(2, dtype=np.float32) >= least
        for i, row in enumerate(same):
            near = label[lo:][row]
            low = near.min()
            if (near != low).any() or label[lo + i] != low:
                label[np.isin(label, near)] = low
    return label


def _in_buckets(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): an edge an item and key at most, that links what may be alike among the rows (key, item, sig) of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _runs(batches, "key", 20_000):
            item, key = whole["item"].to_numpy(), whole["key"].to_numpy()
            sig = np.frombuffer(b"".join(whole["sig"]), np.uint8).reshape(len(item), -1)
            first = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            size = np.diff(first)
            ea, eb = [], []
            two = first[:-1][size == 2]
            near = (sig[two] == sig[two + 1]).mean(1) >= least
            ea.append(item[two[near]])
            eb.append(item[two[near] + 1])
            for lo, n in zip(first[:-1][size > 2].tolist(), size[size > 2].tolist()):
                root = _alike(sig[lo : lo + n], least)
                own = np.flatnonzero(root != np.arange(n))
                ea.append(item[lo + own])
                eb.append(item[lo + root[own]])
            yield pd.DataFrame({"a": np.concatenate(ea), "b": np.concatenate(eb)})

    return rows.select("key", "item", "sig").repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def _candidates(features: DataFrame, least: float, hot: int) -> DataFrame:
    """(a, b): edges that join all items which share a band and may be alike."""
    items = features.groupBy("item").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    count = items.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = items.select("item", "sig", F.explode("bands").alias("key")).join(count, "key")
    out = _in_buckets(rows.where(F.col("n") <= hot), least)
    if not count.where(F.col("n") > hot).limit(1).count():
        return out
    warm, made = written(rows.where(F.col("n") > hot).drop("n"), "hot-buckets"), []
    heads = warm.withColumn("label", F.col("item"))
    for salt in range(ROUNDS):
        size = heads.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("long").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
        dealt = heads.join(size, "key").select(F.xxhash64("key", F.pmod(F.xxhash64("item", F.lit(salt)), F.col("blocks"))).alias("key"), "item", "sig")
        made.append(written(_in_buckets(dealt, least), "hot-edges"))
        if not made[-1].limit(1).count():
            break
        label = components(_all(made), "hot-labels")
        named = warm.join(label.withColumnRenamed("node", "item"), "item", "left").select("key", "item", "sig", F.coalesce("root", "item").alias("label"))
        # one row of each label stands for it in each bucket
        heads = written(named.groupBy("key", "label").agg(F.min(F.struct("item", "sig")).alias("x")).select("key", "label", "x.*"), "hot-heads")
    # buckets of several labels: each block of all the items meets each other
    several = heads.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    rest = warm.join(several, "key", "left_semi")
    size = warm.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("long").alias("blocks"))
    made.append(_in_buckets(rest.join(size, "key").select("item", "sig", F.explode(_meetings(F.col("blocks"))).alias("key")), least))
    return out.unionByName(_all(made))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _meetings(blocks):
    """Keys of the pairs of blocks that a row (key, item) is in: its own with each."""
    own = F.pmod(F.xxhash64("item"), blocks)
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64(F.col("key"), F.least(own, j), F.greatest(own, j)))


def _linked(sets: list[np.ndarray], least: float, label: np.ndarray) -> np.ndarray:
    """The least index that each set is linked with by pairs at ``least`` or more, sets of one label being linked from the start."""
    n, size = len(sets), np.array([len(s) for s in sets], float)
    flat, own = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else new
    own, col = own[shared], np.cumsum(new[shared]) - 1
    inter = np.zeros((n, n), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        rows, at = np.unique(own[a:b], return_inverse=True)
        block = np.zeros((len(rows), 4096), np.float32)
        block[at, col[a:b] - lo] = 1
        inter[np.ix_(rows, rows)] += block @ block.T
    first: dict[int, int] = {}
    start = np.array([first.setdefault(x, i) for i, x in enumerate(label.tolist())])
    ea, eb = [np.arange(n)], [start]
    for i in range(n):
        both = size[i] + size[i + 1 :]
        a = inter[i, i + 1 :].astype(float)
        hit = np.flatnonzero((a >= least * (both - a) - 1e-6) & ((a > 0) | (both == 0)) & (start[i + 1 :] != start[i]))
        ea.append(np.full(len(hit), i))
        eb.append(hit + i + 1)
    return _unions(n, np.concatenate(ea), np.concatenate(eb))


def _in_groups(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): what is linked among the rows (key, item, label, shingles) of each key; an edge an item at most. A key's rows are in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _runs(batches, "key", 500):
            for _, g in whole.groupby("key", sort=False):
                item = g["item"].to_numpy()
                root = _linked([np.frombuffer(x, np.uint32) for x in g["shingles"]], least, g["label"].to_numpy())
                own = np.flatnonzero(root != np.arange(len(item)))
                yield pd.DataFrame({"a": item[own], "b": item[root[own]]})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def _sized(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (root, item, ...) with how many blocks each root's need."""
    size = rows.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("long").alias("blocks"))
    return rows.join(size, "root")


def _verified(some: DataFrame, least: float, block: int) -> list[DataFrame]:
    """Tables of edges (a, b) that link what is alike among the candidates ``some`` (root, item, shingles)."""
    rows = written(_sized(some, block), "candidates")
    dealt = lambda salt: F.xxhash64("root", F.pmod(F.xxhash64("item", F.lit(salt)), F.col("blocks")))
    out = [written(_in_groups(rows.select("item", "shingles", dealt(0).alias("key"), F.col("item").alias("label")), least), "links")]
    large = rows.where("blocks > 1")
    if not large.limit(1).count():
        dropped(rows)
        return out
    label = written(_labels(large.select("item"), out[0]), "labels")
    for salt in range(1, ROUNDS + 1):
        heads = _sized(large.drop("blocks").join(label.where("item = label").select("item"), "item", "left_semi"), block)
        found = written(_in_groups(heads.select("item", "shingles", dealt(salt).alias("key"), F.col("item").alias("label")), least), "links")
        out.append(found)
        if not found.limit(1).count():
            break
        merged = _labels(label.select(F.col("label").alias("item")).distinct(), found)
        then = written(label.join(merged.select(F.col("item").alias("label"), F.col("label").alias("to")), "label").select("item", F.col("to").alias("label")), "labels")
        dropped(label)
        label = then
    out.append(written(_across(large.select("root", "item", "shingles").join(label, "item"), least, block), "links"))
    dropped(label)
    dropped(rows)
    return out


def _across(named: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): what is linked between the clusters of each root of ``named`` (root, item, label, shingles)."""
    return _in_groups(_crossing(named, block, "shingles"), least)


def _crossing(named: DataFrame, block: int, raw: str) -> DataFrame:
    """The rows of ``named`` (root, item, label, ...) by the key of each meeting they are in, blocks being bounded by rows and bytes of ``raw``. What
    isn't of the root's largest cluster meets all items of the root, block by block, so that every two items of different clusters meet."""
    size = named.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum(F.length(raw)).alias("bytes"))
    largest = F.max(F.struct("n", "label", "bytes")).alias("main")
    of = size.groupBy("root").agg(largest, F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > main.n")
    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES)).cast("long")
    of = of.select("root", F.col("main.label").alias("main"), blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("rest"))
    rows = named.join(of, "root").withColumn("i", F.pmod(F.xxhash64("item"), F.col("blocks"))).withColumn("j", F.pmod(F.xxhash64("item"), F.col("rest")))
    all_ = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1), lambda j: F.xxhash64("root", "i", j))
    rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.xxhash64("root", i, "j"))
    columns = [c for c in named.columns if c != "root"]
    return rows.select(*columns, F.explode(all_).alias("key")).unionByName(rows.where("label <> main").select(*columns, F.explode(rest).alias("key")))


def _labels(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, label): edges of one round are stars, so one step finds each one's head."""
    return items.join(edges.select(F.col("a").alias("item"), "b"), "item", "left").select("item", F.coalesce("b", "item").alias("label"))


def _common(found: DataFrame) -> np.ndarray:
    """Shingles of several rows of a bounded sample, sorted. They come last in the order; any choice gives the same links."""
    n = found.count()
    some = found.where(F.pmod(F.xxhash64("item", F.lit("sample")), F.lit(max(1, n // SAMPLE))) == 0).select("item", F.expr(f"substring(shingles, 1, {SAMPLE_BYTES})").alias("x"))
    sets = [np.frombuffer(r["x"], np.uint32) for r in some.dropDuplicates(["item"]).limit(SAMPLE).collect()]
    values, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_counts=True)
    return values[count > 1]


def _prefix(raw: bytes, least: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set: sets at ``least`` or more share one of them."""
    v = np.frombuffer(raw, np.uint32)
    late = np.zeros(len(v), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, v), len(common) - 1)] == v
    return np.concatenate([v[~late], v[late]])[: len(v) - math.ceil(least * len(v) - 1e-6) + 1]


def _prefixes(items: DataFrame, least: float, common: np.ndarray) -> DataFrame:
    """(key, item, label, n, at): a row for each shingle of the prefix of each of ``items`` (item, label, shingles), the at-th of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(2).to_pylist()
            firsts = [_prefix(x, least, common) for x in sets]
            of = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in firsts]))
            n = pa.array([len(x) // 4 for x in sets], pa.int32())
            key = np.concatenate([*firsts, np.zeros(0, np.uint32)]).astype(np.int64)
            at = np.concatenate([*(np.arange(len(x)) for x in firsts), np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(of), batch.column(1).take(of), n.take(of), pa.array(at)], names=["key", "item", "label", "n", "at"])

    return items.select("item", "label", "shingles").mapInArrow(run, "key long, item long, label long, n int, at int")


def _apart(rows: DataFrame, least: float, few: int) -> DataFrame:
    """(hot, key, a, b): pairs of other labels that meet in a key and, by sizes and places, may be alike; of keys of more than ``few`` rows (item, label) as a, b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _runs(batches, "key", 100_000):
            key, item, label, n, at_ = (whole[c].to_numpy() for c in ("key", "item", "label", "n", "at"))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            open_ = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
            for k in np.unique(size[open_ & (size <= few)]).tolist():
                at = first[open_ & (size == k)][:, None]
                i, j = np.triu_indices(k, 1)
                i, j = (at + i).ravel(), (at + j).ravel()
                go = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6)
                # at the first shingle that two sets share, all that they share is still to come
                go &= np.minimum(n[i] - at_[i], n[j] - at_[j]) >= least / (1 + least) * (n[i] + n[j]) - 1e-6
                i, j = item[i[go]], item[j[go]]
                yield pd.DataFrame({"hot": False, "key": 0, "a": np.minimum(i, j), "b": np.maximum(i, j)}).drop_duplicates()
            for lo, k in zip(first[open_ & (size > few)].tolist(), size[open_ & (size > few)].tolist()):
                yield pd.DataFrame({"hot": True, "key": key[lo : lo + k], "a": item[lo : lo + k], "b": label[lo : lo + k]})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "hot boolean, key long, a long, b long")


def _sketch(raw: bytes) -> bytes:
    """The parity of the shingles that fall on each bit; as many bits as shingles or more, a power of two."""
    v = np.frombuffer(raw, np.uint32)
    width = max(64, 1 << (len(v) - 1).bit_length())
    return np.packbits(np.bincount(v & np.uint32(width - 1), minlength=width) & 1, bitorder="little").tobytes()


def _folded(sketch: bytes, size: int) -> bytes:
    """The sketch of as many bytes that the same set has."""
    x = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0).tobytes()


def _may(differ, n, least: float):
    """Whether sets of ``n`` shingles together may be alike to ``least`` if ``differ`` or more are in one alone."""
    return differ <= n * ((1 - least) / (1 + least)) + 1e-3


def _sketches(items: DataFrame) -> DataFrame:
    """(item, n, bits): the number of shingles and the sketch of each of ``items`` (item, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in sets], pa.int32()), pa.array(map(_sketch, sets), pa.binary())], names=["item", "n", "bits"])

    made = items.select("item", "shingles").mapInArrow(run, "item long, n int, bits binary")
    return made.groupBy("item").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))


def _possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that ``sketches`` don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip((batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                size = min(len(x), len(y))
                x, y = (int.from_bytes(_folded(z, size) if len(z) > size else z) for z in (x, y))
                keep.append(_may((x ^ y).bit_count(), n, least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = (sketches.select(F.col("item").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}")) for c in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _sketch_links(label: np.ndarray, n: np.ndarray, bits: list[bytes], least: float) -> np.ndarray:
    """The index of one set, the same for all, of what each is linked with by pairs of other labels that sketches don't rule out."""
    order = np.argsort(n, kind="stable")
    label, n, bits = label[order], n[order], [bits[i] for i in order.tolist()]
    size = np.array([len(x) for x in bits])
    end = np.searchsorted(n, (n + 1e-6) / least, side="right")
    root, ea, eb, held = np.arange(len(n)), [], [], 0
    for width in np.unique(size).tolist():
        # sizes rise with n, so that no later set has a shorter sketch
        lo, up = np.searchsorted(size, [width, width + 1]).tolist()
        words = np.frombuffer(b"".join(_folded(x, width) for x in bits[lo : end[up - 1]]), np.uint64).reshape(-1, width // 8)
        for i in range(lo, up):
            differ = np.bitwise_count(words[i - lo] ^ words[i + 1 - lo : end[i] - lo]).sum(1, dtype=np.int64)
            near = i + 1 + np.flatnonzero(_may(differ, n[i] + n[i + 1 : end[i]].astype(np.int64), least) & (label[i + 1 : end[i]] != label[i]))
            ea.append(np.full(len(near), i))
            eb.append(near)
            held += len(near)
            if held > 1 << 20:
                root = _unions(len(n), np.concatenate([np.arange(len(n)), *ea]), np.concatenate([root, *eb]))
                ea, eb, held = [], [], 0
    root = _unions(len(n), np.concatenate([np.arange(len(n)), *ea]), np.concatenate([root, *eb]))
    out = np.empty_like(root)
    out[order] = order[root]
    return out


def _possible_in_groups(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): an edge an item and key at most, that links what sketches don't rule out among the rows (key, item, label, n, bits) of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _runs(batches, "key", 500):
            for _, g in whole.groupby("key", sort=False):
                item = g["item"].to_numpy()
                root = _sketch_links(g["label"].to_numpy(), g["n"].to_numpy(), g["bits"].tolist(), least)
                own = np.flatnonzero(root != np.arange(len(item)))
                yield pd.DataFrame({"a": item[own], "b": item[root[own]]})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def _pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (item, shingles) are alike to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = (sets.select(F.col("item").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _missed(found: DataFrame, edges: DataFrame, least: float, block: int, few: int) -> list[DataFrame]:
    """Tables of edges (a, b) that link all that is alike among ``found`` and that ``edges`` leave apart."""
    known = components(edges, "known")
    items = found.select("item", "shingles").join(known.hint("merge"), F.col("item") == F.col("node"), "left").groupBy("item").agg(F.first("shingles").alias("shingles"), F.first(F.coalesce("root", "item")).alias("label"))
    apart = written(_apart(_prefixes(items, least, _common(found)), least, few), "apart")
    released(found.sparkSession)
    sketches = written(_sketches(found), "sketches")
    pairs = written(_possible(apart.where("not hot").select("a", "b").distinct(), sketches, least), "pairs")
    hot = written(apart.where("hot").select(F.col("key").alias("root"), F.col("a").alias("item"), F.col("b").alias("label")).join(sketches.hint("merge"), "item"), "hot-prefixes")
    roots = components(_possible_in_groups(_crossing(hot, HOT, "bits"), least), "hot-possible")
    for t in (apart, sketches, hot):
        dropped(t)
    released(found.sparkSession)
    named = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).union(roots.select("node")).distinct()
    sets = written(found.select("item", "shingles").join(named.hint("merge"), "item", "left_semi").groupBy("item").agg(F.first("shingles").alias("shingles")), "sets")
    out = [written(_pairs(pairs, sets, least), "pair-links")]
    if roots.limit(1).count():
        named = sets.join(roots, F.col("item") == F.col("node")).join(known.select(F.col("node").alias("of"), F.col("root").alias("label")), F.col("item") == F.col("of"), "left")
        out.append(written(_across(named.select(roots["root"], "item", F.coalesce("label", "item").alias("label"), "shingles"), least, block), "hot-links"))
    for t in (known, pairs, roots, sets):
        dropped(t)
    return out


def links(found: DataFrame, least: float = LEAST, hot: int = HOT, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(a, b): edges among the items of ``found`` (``features``) that link what shares ``least`` of its shingles."""
    roots = components(_candidates(found, least - 0.2, hot), "alike")
    some = found.join(roots, found["item"] == roots["node"]).groupBy("root", "item").agg(F.first("shingles").alias("shingles"))
    tables = _verified(some, least, block)
    dropped(roots)
    released(found.sparkSession)
    tables += _missed(found, _all(tables), least, block, few)
    out = written(_all(tables), "near-links")
    for t in tables:
        dropped(t)
    return out


def groups(docs: DataFrame, least: float = LEAST, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, group): the smallest doc_id of the texts that hang together by pairs at ``least`` or more."""
    found = written(features(docs, ["doc_id"]), "shingles")
    edges = links(found, least, hot, block)
    roots = components(edges, "near-components")
    of = found.select("doc_id", "item").join(roots, F.col("item") == F.col("node"), "left").select("doc_id", F.coalesce("root", "item").alias("to"))
    out = of.join(of.groupBy("to").agg(F.min("doc_id").alias("group")), "to").select("doc_id", "group")
    out = written(out, "near-groups")
    for t in (found, edges, roots):
        dropped(t)
    released(docs.sparkSession)
    return out
