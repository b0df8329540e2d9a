"""A text index: postings by term, the sizes of kinds, and their upkeep.

A posting is a term in a row of evidence with its places there (counted in tokens), so that BM25, prefixes and phrases
need no text. Postings lie in folders by the first two characters of the term, which an exact term or a prefix of
two characters or more names; in a folder files hold ranges of terms, a hot term several of them by row,
and footers tell which to read.

Writes only append. A row written again, or deleted, is named in ``gone`` with the sequence number that no longer
counts; the sizes of kinds are sums over what each write added and took. ``compact`` writes the index anew without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, phrase_count, tokens
from ..session import ready
from .catalog import selected

ROW = ["kind", "id", "video_id", "t0", "t1", "line", "dl"]
FOLDERS = 256
_ROWS = "kind string, id string, video_id string, t0 double, t1 double, line long, dl long, text string, seq int"
_POSTINGS = "kind string, id string, video_id string, t0 double, t1 double, line long, dl long, term string, pos array<int>, seq int, folder int"
_GONE = "kind string, id string, seq int"
_SIZES = "kind string, rows long, total long"

Word = tuple[str, bool]
Phrase = tuple[list[str], bool]


def _folder(term: Column) -> Column:
    return F.pmod(F.crc32(F.substring(term, 1, 2).cast("binary")), F.lit(FOLDERS)).cast("int")


def _matches(word: Word, term: Column) -> Column:
    return term.startswith(word[0]) if word[1] else term == F.lit(word[0])


def _rows(evidence: DataFrame) -> DataFrame:
    """Evidence with its tokens; ``line`` is a hash of the text."""
    tok = tokens(F.col("text"))
    return evidence.select("kind", "id", "video_id", "t0", "t1", F.xxhash64("text").alias("line"), "text", tok.alias("tok")).withColumn("dl", F.size("tok").cast("long"))


def _posted(rows: DataFrame) -> DataFrame:
    """A row per row of evidence and term: its places. Arrow batches, a row's tokens together, so nothing is shuffled."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok = b.column(len(ROW))
            start, flat = tok.offsets.to_numpy(), tok.flatten().dictionary_encode()
            n = np.diff(start)
            owner, code = np.repeat(np.arange(len(n)), n), flat.indices.to_numpy()
            at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            key = owner * max(1, len(flat.dictionary)) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            whose = pa.array(owner[order[first]])
            pos = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(whose) for i in range(len(ROW))), flat.dictionary.take(pa.array(code[order[first]])), pos], names=[*ROW, "term", "pos"])

    return rows.select(*ROW, "tok").mapInArrow(run, "kind string, id string, video_id string, t0 double, t1 double, line long, dl long, term string, pos array<int>")


def _counted(evidence: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """Each row of evidence with ``f0``, ``f1``, ...: how often each phrase occurs. Texts stay where they are.

    The counts are made as one value, which a generator hands on: a filter on a plain column would move below it and cut the text into tokens again.
    """
    f = [phrase_count(F.col("tok"), p, prefix).alias(f"f{i}") for i, (p, prefix) in enumerate(phrases)]
    rows = _rows(evidence).select(*ROW, "tok")
    return rows.select(*ROW[:-1], F.explode(F.array(F.struct("dl", *f))).alias("x")).select(*ROW[:-1], "x.*")


class Unstored:
    """What an index answers, worked out from evidence when it is asked for: by passes over the texts, of which nothing is shuffled or written."""

    def __init__(self, evidence: DataFrame):
        self.evidence = evidence

    def matched(self, phrases: list[Phrase]) -> DataFrame:
        # a token is a part of the folded text: only rows that hold all words of a phrase somewhere are cut into tokens
        text = fold(F.coalesce(F.col("text"), F.lit("")))
        may = [reduce(Column.__and__, [F.contains(text, F.lit(w)) for w in p]) for p, _ in phrases]
        some = [F.col(f"f{i}") > 0 for i in range(len(phrases))]
        return _counted(self.evidence.where(reduce(Column.__or__, may)), phrases).where(reduce(Column.__or__, some))

    def statistics(self, phrases: list[Phrase], kinds: list[str] | None = None) -> DataFrame:
        return _counted(selected(self.evidence, None, kinds), phrases).groupBy("kind").agg(F.count("*").alias("rows"), F.sum("dl").alias("total"), *_holding(phrases))

    def rows(self) -> DataFrame:
        return self.evidence.select("kind", "id", "video_id", "t0", "t1")

    def texts(self) -> DataFrame:
        return self.evidence.select("kind", "id", "text")


class TextIndex:
    """The index under one folder; ``seq`` of a write must be larger than those before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self._at(name)
        if not self._files(p).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone", _GONE)
        return rows if not gone.limit(1).count() else rows.join(gone, ["kind", "id", "seq"], "left_anti")

    def append(self, evidence: DataFrame, seq: int) -> TextIndex:
        """Add rows of evidence; rows with a key (kind, id) that is there take its place. Texts are cut into tokens once."""
        self.delete(evidence.select("kind", "id"), seq)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        ordered = evidence.select("kind", "id", "video_id", "t0", "t1", "text").repartitionByRange(parts, "kind", "id").sortWithinPartitions("kind", "id")
        rows = self._aside(_rows(ordered), f"tokens-{seq}")
        rows.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("dl").alias("total")).write.mode("append").parquet(f"{self.path}/sizes")
        rows.drop("tok").withColumn("seq", F.lit(seq)).write.mode("append").parquet(f"{self.path}/rows")
        post = self._aside(_posted(rows).withColumn("folder", _folder(F.col("term"))), f"postings-{seq}").withColumn("seq", F.lit(seq))
        post.repartitionByRange("folder", "term", F.xxhash64("id")).sortWithinPartitions("folder", "term", "kind", "id").write.mode("append").partitionBy("folder").parquet(f"{self.path}/postings")
        for name in (f"tokens-{seq}", f"postings-{seq}"):
            p = self._at(name)
            self._files(p).delete(p, True)
        return self

    def _aside(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def delete(self, keys: DataFrame, seq: int) -> None:
        """Rows of these keys (kind, id) no longer count."""
        if not self._files(self._at("rows")).exists(self._at("rows")):
            return
        old = self._read("rows", _ROWS)
        lost = self._live(old.select("kind", "id", "dl", "seq").join(keys.select("kind", "id").distinct(), ["kind", "id"], "left_semi").where(F.col("seq") < seq)).persist()
        if lost.limit(1).count():
            lost.groupBy("kind").agg((-F.count("*")).alias("rows"), (-F.sum("dl")).alias("total")).write.mode("append").parquet(f"{self.path}/sizes")
            lost.select("kind", "id", "seq").write.mode("append").parquet(f"{self.path}/gone")
        lost.unpersist()

    def postings(self, words: list[Word]) -> DataFrame:
        """The live postings of words, each exact or a prefix."""
        every = self._read("postings", _POSTINGS)
        where = F.lit(False)
        for w, prefix in words:
            hit = _matches((w, prefix), F.col("term"))
            where = where | (hit if prefix and len(w) < 2 else (F.col("folder") == zlib.crc32(w[:2].encode()) % FOLDERS) & hit)
        return self._live(every.where(where)).select(*ROW, "term", "pos")

    def sizes(self) -> DataFrame:
        return self._read("sizes", _SIZES).groupBy("kind").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))

    def matched(self, phrases: list[Phrase]) -> DataFrame:
        """One read of the postings for all phrases."""
        of = [[(w, prefix and i == len(p) - 1) for i, w in enumerate(p)] for p, prefix in phrases]
        words = sorted({w for p in of for w in p})
        placed = {w for p in of if len(p) > 1 for w in p}
        name = {w: f"w{i}" for i, w in enumerate(words)}
        agg = []
        for w in words:
            hit = _matches(w, F.col("term"))
            agg.append((F.flatten(F.collect_list(F.when(hit, F.col("pos")))) if w in placed else F.sum(F.when(hit, F.size("pos")).otherwise(0))).alias(name[w]))
        rows = self.postings(words).groupBy(*ROW).agg(*agg)
        count = []
        for i, p in enumerate(of):
            at = F.col(name[p[0]])
            if len(p) == 1:
                n = F.size(at) if p[0] in placed else at
            else:
                for k, w in enumerate(p[1:], 1):
                    at = F.array_intersect(at, _moved(F.col(name[w]), k))
                n = F.size(at)
            count.append(n.cast("long").alias(f"f{i}"))
        return rows.select(*ROW, *count)

    def statistics(self, phrases: list[Phrase], kinds: list[str] | None = None) -> DataFrame:
        every = selected(self.matched(phrases), None, kinds)
        return every.groupBy("kind").agg(*_holding(phrases)).join(self.sizes(), "kind")

    def rows(self) -> DataFrame:
        return self._live(self._read("rows", _ROWS)).select("kind", "id", "video_id", "t0", "t1")

    def texts(self) -> DataFrame:
        return self._live(self._read("rows", _ROWS)).select("kind", "id", "text")

    def compact(self, to: str) -> TextIndex:
        """Write the live rows to another folder, as one append."""
        rows = self._live(self._read("rows", _ROWS)).select("kind", "id", "video_id", "t0", "t1", "text")
        return TextIndex(self.spark, to).append(rows, 0)


Source = DataFrame | TextIndex | Unstored


def index_of(source: Source) -> TextIndex | Unstored:
    return Unstored(source) if isinstance(source, DataFrame) else source


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _holding(phrases: list[Phrase]) -> list[Column]:
    """``n0``, ``n1``, ...: the rows that hold each phrase."""
    return [F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]


def matched(source: Source, phrases: list[Phrase]) -> DataFrame:
    """Rows of evidence that hold a phrase, with ``f0``, ``f1``, ...: how often each phrase occurs; of a stored index also rows that hold words of one.

    The last token of a phrase may be a prefix.
    """
    return index_of(source).matched(phrases)
