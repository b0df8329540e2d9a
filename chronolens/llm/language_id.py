"""Language identification by compression.

Each language has raw-content zstandard dictionaries made of texts known to be
in it. A text is encoded with every language's dictionaries; the language whose
encoding is smallest wins. What a margin is worth in bits gives the score, and a
margin that is narrow rejects the answer (``accepted`` is false).

Letters alone are encoded: the text is lower-cased and everything else counts as
a blank, so digits, markup and symbols vote for no language. Where all sizes tie, the
language with most labelled rows wins.

zstandard stores what it can't make smaller, which would make the sizes of short
texts alike. So every text follows a run of zeros that all languages share and
that makes any block worth encoding.

Null texts and texts without letters are ``und`` with score 0, not accepted. A
single letter or word is a text like any other, with a low score, and rejected, where sizes tie.
Less is compared than is given in two ways: a word said twice in a row is
encoded once, and a line found in the labelled texts of several languages teaches none. Repeated rows and columns
beyond doc_id, text and lang change nothing; an empty table gives no rows, and
with no labelled row every answer is ``und``. Texts are encoded whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

_LETTERS = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\s\d]")
STRETCH = 1 << 20
UNKNOWN = "und"
_LEAD = bytes(192)
LINES = "lang string, at double, tie long, row long, pos long, line string"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, margin_bytes double"


@dataclass(frozen=True)
class Settings:
    """``shards`` dictionaries of ``dictionary_bytes`` a language and one of ``common_bytes`` with
    its commonest words, from at most about ``sample_docs`` labelled documents of it, of each its first
    ``dictionary_bytes // 4`` characters. ``level`` encodes every text; where the
    margin is under ``close_bytes`` a dictionary, ``close_level`` decides. An answer is
    rejected if its margin is under ``min_margin`` bytes a dictionary, whatever the text's length.
    Of labels in more than ``languages`` languages the commonest count, so that the model stays bounded."""

    shards: int = 2
    dictionary_bytes: int = 112_640
    common_bytes: int = 3_072
    sample_docs: int = 400
    level: int = 3
    close_level: int = 19
    close_bytes: float = 6.0
    min_margin: float = 0.5
    languages: int = 256


def _stretches(text: str) -> Iterator[str]:
    """Parts of a text of about ``STRETCH`` characters, cut before a blank or digit, where no word and no rule for lower case goes on."""
    at = 0
    while len(text) - at > STRETCH and (cut := _BREAK.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def letters(text: str | None) -> str:
    """Words of letters, lower-cased; a word said again at once counts once. A long text's words are not all held as objects."""
    out, last = [], None
    for part in _stretches(text or ""):
        words = [w for w, _ in groupby(_LETTERS.findall(part.lower()))]
        if words:
            # the part may begin with the word that the one before ended with
            again, last = words[0] == last, words[-1]
            out.append(" ".join(words[again:]))
    return " ".join(filter(None, out))


def held_out(doc_id, parts: int = 4, part: int = 2):
    """Is the row kept from training? By CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def learn(docs: DataFrame, settings: Settings = Settings()) -> dict[str, list[bytes]]:
    """Dictionaries by language, from a bounded sample of the rows of ``docs`` (doc_id, text, lang).

    The sample is the rows of lowest hash of each language, whatever the order of rows. It stays on
    the executors, a language's share in one task; dictionaries alone come to the driver, at most
    ``languages`` times those of one.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.languages).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, settings.sample_docs / n)))])
    at = F.xxhash64(F.col("doc_id"), F.lit("language")).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    # a text beyond a dictionary's size could fill it alone: its first part serves
    part = F.substring("text", 1, settings.dictionary_bytes // 4).alias("text")
    sample = rows.where(at < share[F.col("lang")]).select("lang", at.alias("at"), part)
    lines = written(sample.select("lang", "at", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_lines, LINES), "language-lines")
    # a line found in several languages, as a licence line, speaks for none
    shared = lines.groupBy("line").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a <> b").select("line", F.lit(True).alias("shared"))

    def dictionaries(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["at", "tie", "row", "pos"])
        texts = [" ".join(g["line"][g["shared"].isna()]) for _, g in own.groupby(["at", "tie", "row"])]
        piles: list[bytearray] = [bytearray() for _ in range(settings.shards)]
        for k, t in enumerate(texts):
            piles[k % settings.shards] += (t + " ").encode()
        whole = [bytes(p[: settings.dictionary_bytes]) for p in piles if len(p) >= 8]
        made = [*(whole[k % len(whole)] for k in range(settings.shards)), common(texts, settings.common_bytes)] if whole else []
        return pd.DataFrame({"lang": own["lang"].iloc[0], "k": np.arange(len(made)), "dictionary": made})

    out: dict[str, list[bytes]] = {}
    for r in sorted(lines.join(shared, "line", "left").groupBy("lang").applyInPandas(dictionaries, "lang string, k long, dictionary binary").collect(), key=lambda r: r["k"]):
        out.setdefault(r["lang"], []).append(bytes(r["dictionary"]))
    dropped(lines)
    # where sizes tie, the commoner language wins
    return {k: out[k] for k in sorted(out, key=lambda k: (-sizes[k], k))}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text, their letters alone."""
    for batch in batches:
        found = [[letters(x) for x in t.split("\n")] for t in batch.column(4).to_pylist()]
        of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        pos = [k for x in found for k in range(len(x))]
        yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[:4]), pa.array(pos, pa.int64()), pa.array([x for y in found for x in y], pa.string())], names=["lang", "at", "tie", "row", "pos", "line"])


def common(texts: list[str], size: int) -> bytes:
    """The commonest words, the most common last: near the text its references are short, which tells short texts apart."""
    best = sorted(Counter(w for t in texts for w in t.split()).items(), key=lambda x: (-x[1], x[0]))
    out, n = [], 0
    for w, _ in best:
        n += len(w.encode()) + 1
        if n > size:
            break
        out.append(w)
    return (" ".join(out[::-1]) + " ").encode()


class Classifier:
    """Compressors of all languages, one process's own."""

    def __init__(self, model: dict[str, list[bytes]], settings: Settings):
        import zstandard as z

        self.langs, self.settings = list(model), settings

        def coders(level: int):
            kept = {}
            for lang in self.langs:
                for d in model[lang]:
                    zd = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
                    zd.precompute_compress(level=level)
                    kept.setdefault(lang, []).append(z.ZstdCompressor(level=level, dict_data=zd, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            return [kept[k] for k in self.langs]

        self.fast, self._coders, self._close = coders(settings.level), coders, None

    def _sizes(self, coders, raw: bytes) -> list[float]:
        return [sum(len(c(raw)) for c in cs) / len(cs) for cs in coders]

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, accepted, margin in bytes."""
        raw = letters(text).encode()
        if not raw or not self.langs:
            return UNKNOWN, 0.0, False, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, True, float(len(raw))
        s = self.settings
        raw = _LEAD + raw + b" "
        sizes = self._sizes(self.fast, raw)
        a, b = sorted(sizes)[:2]
        if b - a < s.close_bytes:
            if self._close is None:
                self._close = self._coders(s.close_level)
            sizes = self._sizes(self._close, raw)
            a, b = sorted(sizes)[:2]
        score = 1 / sum(math.exp(min(0.0, (a - x) * math.log(2))) for x in sizes)
        return self.langs[sizes.index(a)], score, b - a >= s.min_margin, b - a


def identify(docs: DataFrame, model: dict[str, list[bytes]], settings: Settings = Settings()) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text); one pass, no shuffle.

    The model is bounded by its settings and the number of languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(model, settings)
        for batch in batches:
            rows = [own.predict(t) for t in batch.column(2).to_pylist()]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted", "margin_bytes"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def trained_and_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, then answer for all of them."""
    return identify(docs, learn(docs.where(~held_out(F.col("doc_id"))), settings), settings)


def kept(docs: DataFrame, model: dict[str, list[bytes]], settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known by more than a narrow margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(model, settings)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([own.predict(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
