"""SimHash fingerprints and their near pairs by a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree on one of four
16-bit parts, so each is looked for only among those with an equal part. A
part's bucket that is too large for comfort is cut again by one of four 12-bit
parts of the other 48 bits, by the same argument and as exactly.

In a bucket the fingerprints are sorted by Gray rank. Neighbours make nodes,
nodes make upper nodes; a node holds the bits that all below it share (mask and
pattern), the part that its own parent lacks being what it adds. A search goes
down from the roots, adds up the differences on shared bits, and drops a whole
group once they are over the limit. What a bucket found leaves it as one edge a
fingerprint, to the least one it is linked with there, never as all pairs.

Null and empty texts have fingerprint zero and are linked like any other;
texts of one or two words have one shingle, all of it; texts are read whole.
Repeated texts share one fingerprint and are matched once. Null ids are kept,
with the smallest non-null id of the component. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, written
from .components import components

#: a bucket of more fingerprints is cut again
HOT_BUCKET = 20_000
FAN = 8
STRETCH = 1 << 20
#: A-Z in lower case, every blank as a space
_LOWER = bytes(range(9)) + b" " * 5 + bytes(range(14, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``STRETCH`` bytes of it at a time."""
    at = 0
    while len(raw) - at > STRETCH:
        cut = raw.rfind(b" ", at, at + STRETCH)
        if cut <= at:
            cut = raw.find(b" ", at + STRETCH)
            cut = len(raw) if cut < 0 else cut
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split() if at else raw.split()


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    digest = xxhash.xxh64_digest
    ones, total, held = np.zeros(64, np.int64), 0, []
    for more in _word_lists(text.encode().translate(_LOWER)) if text else ():
        found = held + more
        if len(found) >= words:
            n = [len(w) + 1 for w in found]
            joined, ends = b" ".join(found), np.cumsum(n)
            starts, stops = (ends - n)[: len(n) - words + 1].tolist(), (ends - 1)[words - 1 :].tolist()
            raw = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops)]), np.uint8).reshape(-1, 8)
            for k in range(0, len(raw), 65536):
                ones += np.unpackbits(raw[k : k + 65536], axis=1).sum(0, dtype=np.int64)
            total += len(raw)
            found = found[len(found) - words + 1 :]
        held = found
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), seed) if held else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Where a code word stands in Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """The hierarchical index of many buckets at once; ``key`` must be sorted, fingerprints by Gray rank in each."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        self.fp = fp
        group = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.group, every, any_ = group, fp, fp
        last = np.arange(len(fp))
        #: from the leaves up: pattern, mask of shared bits, last leaf, first child, number of children
        self.levels = [(fp, np.full(len(fp), ~np.uint64(0)), last, last, np.ones(len(fp), np.int64))]
        while len(group) and (group[1:] == group[:-1]).any():
            first = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
            at = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            start = np.flatnonzero(at % FAN == 0)
            size = np.diff(np.append(start, len(group)))
            every, any_ = np.bitwise_and.reduceat(every, start), np.bitwise_or.reduceat(any_, start)
            group, last = group[start], last[start + size - 1]
            self.levels.append((every, ~(every ^ any_), last, start, size))

    def pairs(self, lo: int, hi: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): leaves i in [lo, hi) and j > i of the same bucket that differ in at most ``limit`` bits."""
        q, node = np.arange(lo, hi), self.group[lo:hi]
        for depth in range(len(self.levels) - 1, 0, -1):
            first, size = self.levels[depth][3:]
            n = size[node]
            child = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q = np.repeat(q, n)
            pattern, mask, last = self.levels[depth - 1][:3]
            keep = (last[child] > q) & (np.bitwise_count((self.fp[q] ^ pattern[child]) & mask[child]) <= limit)
            q, node = q[keep], child[keep]
        return (q, node) if len(self.levels) > 1 else (q[:0], q[:0])


def star_edges(key: np.ndarray, fp: np.ndarray, limit: int, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within each bucket, at most one a fingerprint."""
    index = GrayIndex(key, fp)
    root = np.arange(len(fp))

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    for lo in range(0, len(fp), rows):
        a, b = index.pairs(lo, min(lo + rows, len(fp)), limit)
        while len(a):
            ra, rb = find(a), find(b)
            go = ra != rb
            if not go.any():
                break
            a, b = a[go], b[go]
            np.minimum.at(root, np.maximum(ra, rb)[go], np.minimum(ra, rb)[go])
    top = find(np.arange(len(fp)))
    own = np.flatnonzero(top != np.arange(len(fp)))
    return fp[own], fp[top[own]]


def near_edges(fps: DataFrame, limit: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): edges among the distinct fingerprints of ``fps`` (fp) that link what differs in at most ``limit`` <= 3 bits."""
    if not 0 <= limit <= 3:
        raise ValueError("four parts hold for at most three differing bits")
    part = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = fps.select("fp", part.alias("p")).withColumn("v", F.expr("shiftrightunsigned(fp, 16 * p) & 65535"))
    count = rows.groupBy("p", "v").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(count, ["p", "v"])
    # the other 48 bits: those above the part move down over it
    rest = F.expr("case p when 0 then shiftrightunsigned(fp, 16) when 3 then fp & 281474976710655L else (fp & (shiftleft(1L, 16 * p) - 1)) | shiftleft(shiftrightunsigned(fp, 16 * p + 16), 16 * p) end")
    cut = rows.withColumn("s", F.explode(F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1)))))
    cut = cut.withColumn("rest", rest).withColumn("w", F.expr("case when s < 0 then 0L else shiftrightunsigned(rest, 12 * s) & 4095 end"))
    keyed = cut.select(F.expr("((p * 65536 + v) * 5 + s + 1) * 4096 + w").cast("long").alias("key"), "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0

        def done(ready: pd.DataFrame) -> pd.DataFrame:
            key, fp = ready["key"].to_numpy(), ready["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(fp), key))
            a, b = star_edges(key[order], fp[order], limit)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 200_000:
                whole = pd.concat(held, ignore_index=True)
                tail = whole["key"].to_numpy() == whole["key"].iloc[-1]
                yield done(whole[~tail].reset_index(drop=True))
                held = [whole[tail]]
                n = 0
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, limit: int = 3, words: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    own = written(fingerprints(docs, words), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_edges(fps.select("fp"), limit, hot), "near")
    of = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    label = of.join(least, "root").select("fp", "component_id")
    return own.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, limit: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near copies the row of least doc_id, one row if several have that id.

    Texts are in one group if their fingerprints differ in at most ``limit`` bits,
    or if 0.8 or more of their five-word shingles are the same: at that share
    fingerprints differ in more bits than an index of parts can find.

    Texts are read once for both. Texts of equal shingles are one node; edges between
    nodes come from near fingerprints and from alike shingles, and components are made of all
    of them together. Rows are known by a 64-bit hash of id and text: those that repeat both are one,
    those that repeat an id with another text are not. Only ids, hashes and
    fingerprints are shuffled to join the groups; the texts move once, to meet the
    rows that go. Rows without an id are kept.
    """
    from . import near_copies

    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.where("doc_id is not null").select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    found = written(near_copies.features(keyed, ["row", "id"], fingerprints=True), "near-features")
    of_fp = written(found.groupBy("fp").agg(F.min("item").alias("rep")), "fingerprints")
    same = found.select("fp", "item").distinct().join(of_fp, "fp").where("item <> rep").select(F.col("item").alias("a"), F.col("rep").alias("b"))
    near = near_edges(of_fp.select("fp"), limit).join(of_fp.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    alike = near_copies.links(found)
    roots = components(same.unionByName(near.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).unionByName(alike), "joined")
    named = written(found.select("row", "id", "item").distinct().join(roots, F.col("item") == F.col("node"), "left").select("row", "id", F.coalesce("root", "item").alias("root")), "named")
    first = named.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first"))
    gone = written(named.join(first, "root").where("row <> first.row").select(F.col("row").alias("_row")), "gone")
    again = written(found.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("k")).where("k > 1").select("_row"), "again")
    for x in (found, of_fp, alike, roots, named):
        dropped(x)
    released(docs.sparkSession)
    # joined in the same way at every size: rows that go grow with the rows
    out = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), row)).join(gone.hint("merge"), "_row", "left_anti")
    if not again.limit(1).count():
        return out.select(*docs.columns)
    single = out.join(again.hint("merge"), "_row", "left_anti")
    return single.unionByName(out.join(again.hint("merge"), "_row", "left_semi").dropDuplicates(["_row"])).select(*docs.columns)
