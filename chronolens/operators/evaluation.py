"""Evaluation measures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import lower_percentile, wilson


def accuracy(runs: DataFrame, by: list[str]) -> DataFrame:
    """n, hits, accuracy and its Wilson interval of rows with ``correct``, by group."""
    g = runs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"))
    return g.withColumn("accuracy", F.col("hits") / F.col("n")).withColumn("w", wilson(F.col("hits"), F.col("n"))).select(*by, "n", "hits", "accuracy", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))


def by_task(runs: DataFrame) -> DataFrame:
    """Accuracy by task type; a run counts for each of its types, one without for ``unknown``."""
    types = F.when(F.coalesce(F.size("task_types"), F.lit(0)) > 0, F.col("task_types")).otherwise(F.array(F.lit("unknown")))
    return accuracy(runs.withColumn("task", F.explode(types)), ["task"])


def latency(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Lower percentiles. Values are first counted, so a group's row holds its distinct values only."""
    v = F.collect_list(value)
    return runs.groupBy(*by).agg(lower_percentile(v, 0.5).alias("p50"), lower_percentile(v, 0.95).alias("p95"))


def percentile_low(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The element at place int(q (n - 1)) of each sorted group, by window and without collecting the group."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(value)) - 1
    return rows.withColumn("__n", n).withColumn("__i", at).where(F.col("__i") == F.floor(F.lit(q) * (F.col("__n") - 1))).select(*by, F.col(value).alias(f"p{round(q * 100)}"))


def tool_sequences(runs: DataFrame, most: int = 8) -> DataFrame:
    return runs.groupBy(F.array_join("tools", " > ").alias("sequence")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sequence").limit(most)


def set_scores(claimed: Column, expected: Column, acceptable: Column) -> Column:
    """precision, recall and F1 of claimed items: acceptable ones aren't wrong, expected ones are wanted. Empty against empty is right."""
    right = F.size(F.array_intersect(claimed, F.array_union(expected, acceptable)))
    found = F.size(F.array_intersect(claimed, expected))
    p = F.when(F.size(claimed) > 0, right / F.size(claimed)).otherwise(F.when(F.size(expected) == 0, 1.0).otherwise(0.0))
    r = F.when(F.size(expected) > 0, found / F.size(expected)).otherwise(1.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def retrieval(ranks: DataFrame, k: int = 5) -> DataFrame:
    """hit@1, hit@k and mean reciprocal rank of questions with the ``rank`` of their first right hit, null if none."""
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("n"), F.avg(F.coalesce((r == 1).cast("double"), F.lit(0.0))).alias("hit1"), F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))).alias("hitk"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"))


def accepted(answer: Column, accept: Column) -> Column:
    """Does an answer hold any accepted string, case ignored?"""
    return F.exists(accept, lambda a: F.lower(answer).contains(F.lower(a)))


def cited_near(citations: Column, anchor: Column, secs: float = 90.0) -> Column:
    """Does any citation (t0, t1) come within ``secs`` of an anchor?"""
    return F.exists(citations, lambda c: (c["t0"] - secs <= anchor) & (c["t1"] + secs >= anchor))


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Rows by group and first upper bound that holds the value; beyond the last: overflow."""
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[i], F.lit(i)).otherwise(bucket)
    return rows.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def stratified(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 1) -> DataFrame:
    """About ``n`` rows, each stratum in proportion and one of it at least, by a hash of the key (MD5 of key and seed)."""
    total = rows.count()
    w = Window.partitionBy(stratum)
    quota = F.greatest(F.lit(1), F.round(F.lit(float(n)) * F.count("*").over(w) / F.lit(float(max(total, 1)))).cast("int"))
    at = F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key))
    return rows.withColumn("__q", quota).withColumn("__n", at).where(F.col("__n") <= F.col("__q")).drop("__q", "__n")


_LINE = {"uri": r"^indexing (.+)$", "secs": r"probed: .*?(\d+:\d\d:\d\d(?:\.\d+)?)", "wall": r"^finished .* in (\d+(?:\.\d+)?) ?s"}


def run_timings(logs: DataFrame) -> DataFrame:
    """uri, secs, wall: of each video the run that took longest, from the lines of logs (log, n, line); runs that didn't finish don't count."""
    at = lambda k: F.nullif(F.regexp_extract("line", _LINE[k], 1), F.lit(""))
    w = Window.partitionBy("log").orderBy("n")
    rows = logs.withColumn("line", F.regexp_replace("line", "\x1b\\[[0-9;]*m", "")).withColumn("uri", at("uri"))
    rows = rows.withColumn("run", F.count("uri").over(w))
    runs = rows.where("run > 0").groupBy("log", "run").agg(F.max("uri").alias("uri"), F.max(at("secs")).alias("clock"), F.max(at("wall").cast("double")).alias("wall")).where("wall is not null")
    secs = F.aggregate(F.transform(F.split("clock", ":"), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a * 60 + x)
    return runs.groupBy("uri").agg(F.max_by(F.struct(F.coalesce(secs, F.lit(0.0)).alias("secs"), "wall"), F.struct("wall", "log", "run")).alias("r")).select("uri", "r.*")


def speed(timings: DataFrame) -> DataFrame:
    """videos, secs, wall, speed (times real time) over all runs."""
    return timings.agg(F.count("*").alias("videos"), F.sum("secs").alias("secs"), F.sum("wall").alias("wall"), (F.sum("secs") / F.sum("wall")).alias("speed"))
