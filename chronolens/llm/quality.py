"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (its words, hashed to
``WORDS`` rows of a learned table, how often each kind
of character follows each other kind, and how words repeat, through a learned
layer); gated attention, learned from the documents' labels alone, weighs the
passages; the weighted sum is scored. Reference: attention-based deep
multiple-instance learning (Ilse, Tomczak, Welling 2018), gated form.

Null and empty texts are one empty passage and get the score that has. A
passage is ``PASSAGE`` bytes of the UTF-8 text; texts are scored whole, however
long, some passages at a time. Of a long labelled text passages from all over it teach. Repeated rows give repeated scores; of several labels for one id the mean
counts (0.5 teaches nothing and is left out). Columns beyond doc_id and text are ignored. Without any label every
score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 512
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_KINDS = ["\n", "0123456789", ".", ",", "!?", "|", "#*$%&@~^", "'\"-;:()[]"]
#: kinds of bytes: blank, those above, other control or sign, lower, upper, not ASCII
_KIND = np.full(256, len(_KINDS) + 1, np.int64)
for _k, _s in enumerate(_KINDS, 1):
    _KIND[[ord(c) for c in _s]] = _k
_KIND[32] = 0
_KIND[97:123], _KIND[65:91], _KIND[128:] = len(_KINDS) + 2, len(_KINDS) + 3, len(_KINDS) + 4
N_KINDS = len(_KINDS) + 5
WORDS = 512
N_PLAIN = N_KINDS * N_KINDS + 3
N_FEATURES = N_PLAIN + WORDS
#: passages whose features are held at a time
TOGETHER = 2_048
_SIGN = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = np.multiply.accumulate(np.append(np.uint64(1), np.full(PASSAGE, 0x9E3779B97F4A7C15, np.uint64)))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@dataclass(frozen=True)
class Settings:
    """Learning reads at most about ``sample_docs`` labelled documents of each class; of each at most ``sample_passages``
    passages, evenly spaced over the text where it has more. ``words`` is what a word's share counts against
    that of kinds of characters: there are many words, each in few passages."""

    sample_docs: int = 1500
    sample_passages: int = 40
    hidden: int = 24
    attention: int = 12
    steps: int = 600
    batch: int = 128
    rate: float = 0.01
    decay: float = 3e-3
    words: float = 0.2


def _laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each passage begins and how long it is, and the first passage of each text; a text has one at least."""
    raw = [(t or "").encode() for t in texts]
    n = np.array([len(r) for r in raw], np.int64)
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(per) - per
    doc_at = np.cumsum(n) - n
    begin = np.repeat(doc_at, per) + (np.arange(int(per.sum())) - np.repeat(first, per)) * PASSAGE
    size = np.minimum(np.repeat(doc_at + n, per) - begin, PASSAGE)
    return np.frombuffer(b"".join(raw), np.uint8), begin, size, first


def _features(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Features (float32) of passages that follow each other."""
    total = len(begin)
    x = np.zeros((total, N_FEATURES), np.float32)
    flat = flat[begin[0] : begin[-1] + size[-1]] if total else flat[:0]
    if len(flat):
        begin = begin - begin[0]
        owner = np.repeat(np.arange(total), size)
        kind = _KIND[flat]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[begin[size > 0]] = 1  # a passage starts as if after a line's end
        pairs = np.bincount(owner * (N_KINDS * N_KINDS) + before * N_KINDS + kind, minlength=total * N_KINDS * N_KINDS)
        x[:, : N_PLAIN - 3] = pairs.reshape(total, -1)
        blank = _BLANK[flat]
        head = ~blank
        head[1:] &= blank[:-1] | (owner[1:] != owner[:-1])
        start = np.flatnonzero(head)
        if len(start):
            at = np.arange(start[0], len(flat)) - np.repeat(start, np.diff(np.append(start, len(flat))))
            value = np.where(blank[start[0] :], np.uint64(0), _SIGN[_LOWER[flat[start[0] :]]] * _POWER[np.minimum(at, PASSAGE)])
            word = np.add.reduceat(value, start - start[0])
            of = owner[start]
            x[:, N_PLAIN - 3] = np.bincount(of, minlength=total)
            for lag, col in ((1, N_PLAIN - 2), (2, N_PLAIN - 1)):
                same = (word[lag:] == word[:-lag]) & (of[lag:] == of[:-lag])
                x[:, col] = np.bincount(of[lag:][same], minlength=total)
            row = (word * np.uint64(0x7FB5D329728EA185) >> np.uint64(32)).astype(np.int64) % WORDS
            x[:, N_PLAIN:] = np.bincount(of * WORDS + row, minlength=total * WORDS).reshape(total, WORDS)
    x /= np.maximum(size, 1)[:, None].astype(np.float32)
    return np.sqrt(x, out=x)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's begin."""
    flat, begin, size, first = _laid_out(texts)
    some = [_features(flat, begin[lo : lo + TOGETHER], size[lo : lo + TOGETHER]) for lo in range(0, len(begin), TOGETHER)]
    return np.concatenate(some) if some else np.zeros((0, N_FEATURES), np.float32), first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class AttentionBag:
    """The network: ``h = tanh(xW)``, weights ``softmax(w . (tanh(hV) * sigmoid(hU)))``, score ``sigmoid(z . c)``."""

    def __init__(self, settings: Settings, seed: int = 7):
        g, s = np.random.default_rng(seed), settings
        f, d, a = N_FEATURES, s.hidden, s.attention
        self.settings, self.mean, self.scale = s, np.zeros(f), np.ones(f)
        self.p = {"W": g.normal(0, f**-0.5, (f, d)), "b": np.zeros(d), "V": g.normal(0, d**-0.5, (d, a)), "U": g.normal(0, d**-0.5, (d, a)), "w": g.normal(0, a**-0.5, a), "c": g.normal(0, d**-0.5, d), "o": np.zeros(1)}

    def _encoded(self, x: np.ndarray):
        """Of each passage: its representation, the gate's two sides, and its weight before it is shared out."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, g, np.exp(np.clip((t * g) @ p["w"], -30, 30))

    def _weighed(self, h: np.ndarray, e: np.ndarray, first: np.ndarray):
        """Attention weights, weighted representation and output of each bag."""
        per = np.diff(np.append(first, len(h)))
        a = e / np.repeat(np.add.reduceat(e, first), per)
        z = np.add.reduceat(a[:, None] * h, first)
        return a, z, z @ self.p["c"] + self.p["o"][0], per

    def _forward(self, x: np.ndarray, first: np.ndarray):
        h, t, g, e = self._encoded(x)
        a, z, out, per = self._weighed(h, e, first)
        return h, t, g, a, z, out, per

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> AttentionBag:
        self.mean, self.scale = x.mean(0, dtype=float).astype(np.float32), (x.std(0, dtype=float) + 1e-3).astype(np.float32)
        s, p = self.settings, self.p
        self.scale[N_PLAIN:] /= s.words
        ends, g = np.append(first[1:], len(x)), np.random.default_rng(11)
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        for step in range(1, s.steps + 1):
            pick = g.integers(0, len(first), s.batch)
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in pick])
            at = np.cumsum(ends[pick] - first[pick]) - (ends[pick] - first[pick])
            xb = (x[rows] - self.mean) / self.scale
            h, t, q, a, z, out, per = self._forward(xb, at)
            d = (_sigmoid(out) - label[pick]) * weight[pick] / len(pick)
            dz = d[:, None] * p["c"]
            dzr = np.repeat(dz, per, axis=0)
            da = (dzr * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, at), per))
            dt, dq = de[:, None] * p["w"] * q * (1 - t * t), de[:, None] * p["w"] * t * q * (1 - q)
            dh = a[:, None] * dzr + dt @ p["V"].T + dq @ p["U"].T
            dpre = dh * (1 - h * h)
            grad = {"W": xb.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dq, "w": (t * q).T @ de, "c": z.T @ d, "o": np.array([d.sum()])}
            rate = s.rate * (1 - (step - 1) / s.steps)
            for k, dk in grad.items():
                dk = dk + s.decay * p[k] * (k not in "bo")
                m[k], v[k] = 0.9 * m[k] + 0.1 * dk, 0.999 * v[k] + 0.001 * dk * dk
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text; features are made of ``TOGETHER`` passages at a time."""
        if not texts:
            return np.zeros(0)
        flat, begin, size, first = _laid_out(texts)
        some = [self._encoded((_features(flat, begin[lo : lo + TOGETHER], size[lo : lo + TOGETHER]) - self.mean) / self.scale) for lo in range(0, len(begin), TOGETHER)]
        return _sigmoid(self._weighed(np.concatenate([x[0] for x in some]), np.concatenate([x[3] for x in some]), first)[2])


def held_out(doc_id, parts: int = 3, part: int = 1):
    """Is the row kept from training? By CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> AttentionBag | None:
    """Fit on a bounded sample of labelled rows.

    Each class is sampled by a hash of the id, at a rate that its count sets;
    weights undo the difference of rates, so that scores are probabilities. Only
    the sample comes to the driver.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("mean"))
    one = one.where("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).alias("good"))
    counts = {r["good"]: r["n"] for r in one.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rate = {k: min(1.0, settings.sample_docs / n) for k, n in counts.items()}
    at = F.xxhash64(F.col("doc_id"), F.lit("quality")).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    picked = one.where(at < F.when(F.col("good"), rate[True]).otherwise(rate[False])).toPandas()
    if picked.empty:
        return None
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(picked, "doc_id long, good boolean"))
    text, k = F.coalesce(F.col("text"), F.lit("")), settings.sample_passages
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(small, "doc_id")
    n = F.length("text")
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring("text", (F.floor(i * (n - PASSAGE) / max(1, k - 1)) + 1).cast("int"), F.lit(PASSAGE)))
    rows = rows.select("doc_id", "good", F.when(n <= k * PASSAGE, F.col("text")).otherwise(F.array_join(spread, "")).alias("text"))
    sample = rows.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text")).toPandas().sort_values("doc_id")
    good = sample["good"].to_numpy(bool)
    if good.all() or not good.any():
        return None
    x, first = passages(sample["text"].tolist())
    del sample
    # the rarer rate stands for more documents
    weight = np.where(good, 1 / rate[True], 1 / rate[False])
    return AttentionBag(settings).fit(x, first, good.astype(float), weight / weight.mean())


def score(docs: DataFrame, model: AttentionBag | None) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text); one pass, no shuffle; the model's size is fixed by its settings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe_automaton import sliced

        for batch in batches:
            out = [model.scores(ts) if model else np.full(len(ts), 0.5) for ts in sliced(batch.column(2).to_pylist(), 500_000)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def trained_and_scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the labels of rows that are not held out, then score every row."""
    return score(docs, learn(docs, labels.where(~held_out(F.col("doc_id"))), settings))


def kept(docs: DataFrame, model: AttentionBag | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe_automaton import sliced

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            good = [s >= threshold for ts in sliced(texts, 500_000) for s in (model.scores(ts) if model else np.full(len(ts), 0.5))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
