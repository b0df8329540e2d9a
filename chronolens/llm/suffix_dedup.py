"""Removal of repeated byte strings with suffix order and longest-previous-factor arrays.

Texts are UTF-8 bytes. A string of ``WINDOW`` bytes that starts at two places is
repeated, and every byte that a repeated string covers goes (``keep_first``:
only bytes of strings that also start earlier, by doc_id and place).

A suffix order of the whole corpus fits no machine, so suffixes are first
brought together by content. Each window is filed under its minimizer, the
least-hashed string of ``ANCHOR`` bytes in it, leftmost if tied. Equal windows
have equal minimizers at equal places. Neighbouring windows with the same
minimizer form one run of text; a run is known by a hash, counted, and
  * a minimizer seen once ends there, with all its windows unrepeated;
  * runs seen twice or more are repeated whole;
  * the other runs of a shared minimizer are compared: one of each kind comes to
    the minimizer's bucket, whose windows are put in suffix order. The longest
    common prefixes of neighbours there, and for earlier matches the previous
    and next smaller positions in that order (the longest-previous-factor
    array), say which windows are repeated.
A bucket of more than ``HOT`` kinds of runs is not put into one task, and no suffix order is made of it: its
windows are counted by a 128-bit hash each, which is as exact and spreads evenly.

A run is named by two 64-bit hashes, a text by one and its length: two different
texts of equal length are taken for one with probability 2^-64.

Null texts are empty. Texts under 200 bytes lose nothing. Repeated rows repeat
the text: each byte of a text of 200 bytes or more that occurs in two rows goes;
with ``keep_first`` the rows of the least doc_id keep what is first in them, also
if there are several.
Null ids come before all others. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, written

WINDOW = 200
ANCHOR = 60
HOT = 20_000
STRETCH = 1 << 20
_BYTE = np.random.default_rng(200).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _rolling(flat: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of ``size`` bytes."""
    n = len(flat)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _powers(_BASE, n), out=total[1:])
    h = (total[size:] - total[:-size]) * _powers(_INVERSE, n - size + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(29)
    return h


def runs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, windows, minimizer) of the runs of some texts; together they have each window once.

    Texts are read in stretches of ``STRETCH`` windows; a run that goes on over a cut is one.
    """
    out, held, n = [], [], 0

    def flush() -> None:
        if held:
            text, start, many, mk, _ = _runs([raw[i] for i in held])
            out.append((np.array(held)[text], start, many, mk))
            held.clear()

    for i, r in enumerate(raw):
        if len(r) < WINDOW:
            continue
        if len(r) <= STRETCH + WINDOW - 1:
            held.append(i)
            n += len(r)
            if n > STRETCH:
                flush()
                n = 0
            continue
        flush()
        n = 0
        parts = []
        for lo in range(0, len(r) - WINDOW + 1, STRETCH):
            _, start, many, mk, at = _runs([r[lo : lo + STRETCH + WINDOW - 1]])
            parts.append((start + lo, many, mk, at + lo))
        start, many, mk, at = map(np.concatenate, zip(*parts))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append((np.full(len(first), i), start[first], np.add.reduceat(many, first), mk[first]))
    flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    return tuple(map(np.concatenate, zip(*out)))


def _runs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of ``WINDOW`` bytes or more, at once; and where the minimizer stands in its text."""
    n = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    h = _rolling(flat, ANCHOR)
    # 30 bits of hash over 34 of place, whatever the lengths: equal windows must have equal minimizers
    place = np.uint64((1 << 34) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, WINDOW - ANCHOR + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low & place).astype(np.int64)
    begin = np.cumsum(n) - n
    many = n - WINDOW + 1
    text = np.repeat(np.arange(len(raw)), many)
    start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = at[np.repeat(begin, many) + start]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    return text[first], start[first], np.diff(np.append(first, len(at))), h[at[first]], at[first] - begin[text[first]]


def suffix_order(flat: np.ndarray, start: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``start`` sorted by their first ``size`` bytes, earlier places first if equal; and the
    common prefix of each with the one before it, up to ``size``, 0 for the first; exact where it is ``size``.
    Ties alone go on to the next eight bytes."""
    n = len(start)
    padded = np.append(flat, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order, lcp, open_ = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    group = np.zeros(n, np.int64)
    live = np.arange(n)
    for depth in range(0, size, 8):
        if not len(live):
            break
        at = start[order[live]] + depth
        word = eight[at].copy().view(">u8").ravel().astype(np.uint64)
        if size - depth < 8:
            word >>= np.uint64(8 * (8 - (size - depth)))
        inner = np.lexsort((word, group[live]))
        order[live] = order[live][inner]
        word = word[inner]
        same = np.append(False, (group[live][1:] == group[live][:-1]) & (word[1:] == word[:-1]))
        lcp[live[same]] = min(depth + 8, size)
        group[live] = np.cumsum(~same)
        open_[:] = False
        open_[live] = same
        open_[live[:-1]] |= same[1:]
        live = np.flatnonzero(open_)
    return order, lcp


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix that also starts at an earlier place.

    In suffix order the best earlier matches are the nearest suffixes on either
    side whose places are smaller; the shortest common prefix between is theirs.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    rank = place[order].tolist()
    near = lcp.tolist()
    for side in (range(n), range(n - 1, -1, -1)):
        down = side.step > 0
        stack: list[tuple[int, int]] = []  # (place, prefix shared with the one over it)
        gap = 0
        best = [0] * n
        for i in side:
            gap = near[i] if down else (near[i + 1] if i + 1 < n else 0)
            while stack and stack[-1][0] >= rank[i]:
                gap = min(gap, stack.pop()[1])
            best[i] = gap if stack else 0
            stack.append((rank[i], gap))
        out[order] = np.maximum(out[order], best)
    return out


def _repeated(flat: np.ndarray, start: np.ndarray, place: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which windows of a bucket are equal to another (``keep_first``: to an earlier)."""
    order, lcp = suffix_order(flat, start)
    whole = lcp >= WINDOW
    hit = whole | np.append(whole[1:], False)
    out = np.zeros(len(start), bool)
    if not keep_first:
        out[order[hit]] = True
    else:
        some = np.flatnonzero(hit)
        own = order[some]
        out[own] = longest_previous_factor(np.arange(len(own)), lcp[some], place[own]) >= WINDOW
    return out


def _text_key(raw: bytes) -> tuple[int, int]:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64)), len(raw)


def _all_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from .bpe_automaton import sliced

        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for texts in sliced(batch.column(1).to_pylist(), 2_000_000):
                raw = [(t or "").encode() for t in texts]
                text, start, n, mk = runs(raw)
                keys = [_text_key(r) if len(r) >= WINDOW else (0, 0) for r in raw]
                digest = xxhash.xxh3_64_digest
                sk = np.frombuffer(b"".join([digest(raw[t][s : s + k + WINDOW - 1]) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist())]), np.int64)
                th, nb = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
                own = pa.array(ids[at : at + len(raw)], pa.int64()).take(pa.array(text))
                at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mk.view(np.int64)), pa.array(sk), own, pa.array(th[text]), pa.array(nb[text]), pa.array(start), pa.array(n.astype(np.int32))],
                    names=["mk", "sk", "doc_id", "th", "nb", "start", "n"],
                )

    return docs.mapInArrow(run, "mk long, sk long, doc_id long, th long, nb long, start long, n int")


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (th, nb, start, n, ...) with the bytes of each run."""
    keyed = _keyed(docs).where(F.length("raw") >= WINDOW)
    some = wanted.groupBy("th", "nb").agg(F.collect_list(F.struct("mk", "sk", "doc_id", "start", "n", "hot", "many")).alias("runs"))
    cut = keyed.join(some, ["th", "nb"]).select("th", "nb", "raw", F.explode("runs").alias("r"))
    return cut.select("th", "nb", "r.*", F.expr(f"substring(raw, cast(r.start + 1 as int), cast(r.n + {WINDOW - 1} as int))").alias("bytes"))


def _keyed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            keys = [_text_key(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "th", "nb", "raw"])

    return docs.mapInArrow(run, "doc_id long, th long, nb long, raw binary")


def _in_buckets(rows: DataFrame, keep_first: bool) -> DataFrame:
    """(th, nb, start, n): stretches of windows found repeated in the buckets of ``rows``; a bucket's rows are in one task."""

    def done(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["mk", "sk"]).reset_index(drop=True)
        if keep_first:
            part = part.sort_values(["doc_id", "th", "nb", "start"], na_position="first").reset_index(drop=True)
        n = part["n"].to_numpy(np.int64)
        size = n + WINDOW - 1
        flat = np.frombuffer(b"".join(part["bytes"]), np.uint8)
        own = np.repeat(np.arange(len(part)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        hit = _repeated(flat, np.repeat(np.cumsum(size) - size, n) + step, np.arange(len(own)), keep_first)
        edge = np.append(True, (own[1:] != own[:-1]) | (hit[1:] != hit[:-1])) if len(own) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        length = np.diff(np.append(first, len(own)))
        go = hit[first]
        row = own[first[go]]
        return pd.DataFrame({"th": part["th"].to_numpy()[row], "nb": part["nb"].to_numpy()[row], "start": part["start"].to_numpy()[row] + step[first[go]], "n": length[go]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 8_000:
                whole = pd.concat(held, ignore_index=True)
                tail = whole["mk"].to_numpy() == whole["mk"].iloc[-1]
                if not tail.all():
                    yield done(whole[~tail])
                held, n = [whole[tail]], int(tail.sum()) if not tail.all() else 0
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return rows.repartition("mk").sortWithinPartitions("mk").mapInPandas(run, "th long, nb long, start long, n long")


def _by_windows(rows: DataFrame, keep_first: bool) -> DataFrame:
    """The same for buckets too large for a task, by a hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for r in batch.to_pylist():
                b = r["bytes"]
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b[i : i + WINDOW]) for i in range(r["n"])]), np.int64).reshape(-1, 2)
                k = r["n"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([r["doc_id"]] * k, pa.int64()), pa.array([r["th"]] * k, pa.int64()), pa.array([r["nb"]] * k, pa.int64()), pa.array(r["start"] + np.arange(k))],
                    names=["h0", "h1", "doc_id", "th", "nb", "start"],
                )

    w = rows.dropDuplicates(["mk", "sk"]).select("doc_id", "th", "nb", "start", "n", "bytes").mapInArrow(run, "h0 long, h1 long, doc_id long, th long, nb long, start long")
    place = F.struct("doc_id", "th", "nb", "start")
    seen = w.groupBy("h0", "h1").agg(F.count("*").alias("k"), F.min(place).alias("first")).where("k > 1")
    hit = w.join(seen, ["h0", "h1"])
    if keep_first:
        hit = hit.where(~place.eqNullSafe(F.col("first")))
    return hit.select("th", "nb", "start", F.lit(1).cast("long").alias("n"))


def repeats(docs: DataFrame, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """(th, nb, spans): what to remove from each text that loses anything.

    ``th`` and ``nb`` name the text, ``spans`` is a sorted array of [start, end),
    unmerged. With ``keep_first`` also ``first``, the least doc_id of a text of
    several rows: the others lose all of it, and ``spans`` is what the first loses.
    """
    spark = docs.sparkSession
    every = written(_all_runs(docs), "runs")
    seen = every.groupBy("mk").agg(F.count("*").alias("total")).where("total > 1")
    some = written(every.join(seen, "mk").drop("total"), "shared-runs")
    dropped(every)
    del every, seen
    released(spark)
    place = F.struct("doc_id", "th", "nb", "start", "n")
    kinds = some.groupBy("mk", "sk").agg(F.count("*").alias("k"), F.min(place).alias("first"))
    kinds = written(kinds, "kinds")
    buckets = kinds.groupBy("mk").agg(F.count("*").alias("d"))
    # runs of one kind are repeated whole; with keep_first all but the first
    many = kinds.where("k > 1").select("mk", "sk", "first")
    whole = some.join(many, ["mk", "sk"])
    if keep_first:
        whole = whole.where(~(F.struct("th", "nb", "start") == F.struct("first.th", "first.nb", "first.start")))
    whole = whole.select("th", "nb", "start", F.col("n").cast("long").alias("n")).distinct()
    wanted = kinds.join(buckets.where("d > 1"), "mk").select("mk", "sk", "first.*", (F.col("d") > hot).alias("hot"), (F.col("k") > 1).alias("many"))
    rows = written(_contents(docs, wanted), "bucket-rows")
    found = _in_buckets(rows.where("not hot"), keep_first)
    if buckets.where(F.col("d") > hot).limit(1).count():
        found = found.unionByName(_by_windows(rows.where("hot"), keep_first))
    spans = whole.unionByName(found).distinct()
    out = spans.groupBy("th", "nb").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end")))).alias("spans"))
    if keep_first:  # of several rows with one text the first alone keeps anything
        rows_of = some.where("start = 0").groupBy("th", "nb").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        out = out.join(rows_of, ["th", "nb"], "full").select("th", "nb", "spans", "first")
    out = written(out, "spans")
    for t in (some, kinds, rows):
        dropped(t)
    del some, kinds, rows, buckets, many, whole, wanted, found, spans
    released(spark)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            if s["end"] > out[-1][1]:
                out[-1] = (out[-1][0], s["end"])
        else:
            out.append((s["start"], s["end"]))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row per document: n_bytes, n_removed, n_spans, kept_sha256; every copy of a repeated string goes."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = _keyed(docs).join(repeats(docs, hot=hot), ["th", "nb"], "left").select("doc_id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column(1), batch.column(2)):
                raw, gone = raw.as_py(), merged(spans.as_py() or [])
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), sha256(_kept(raw, gone)).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with later copies of repeated strings cut from ``text``; the first copy, by doc_id and place, stays.

    Cut ends may fall inside a character of several bytes; its other bytes go too.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = repeats(slim, keep_first=True, hot=hot)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            text = []
            for t, i, spans, first in zip(get("text"), get("doc_id"), get("__spans"), get("__first")):
                if first is not None and i != first["doc_id"]:
                    t = ""
                elif spans:
                    t = _kept(t.encode(), merged(spans)).decode("utf-8", "ignore")
                text.append(t)
            cols = [pa.array(text, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [_text_key((t or "").encode()) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64())], names=[*names, "__th", "__nb"])

    wide = docs.mapInArrow(keys, _with_keys(docs))
    joined = wide.join(gone.select(F.col("th").alias("__th"), F.col("nb").alias("__nb"), F.col("spans").alias("__spans"), F.col("first").alias("__first")), ["__th", "__nb"], "left").select(*names, "__spans", "__first")
    return joined.mapInArrow(run, docs.schema)


def _with_keys(docs: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField("__th", T.LongType()), T.StructField("__nb", T.LongType())])
