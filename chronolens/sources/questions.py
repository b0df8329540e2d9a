"""Benchmark questions from their published files: benchmark, id, video_key, question, options, answer, task_types, time_reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["benchmark", "id", "video_key", "question", "options", "answer", "task_types", "time_reference"]
LVBENCH = "key string, type string, qa array<struct<uid: string, question: string, answer: string, question_type: array<string>, time_reference: string>>"
MINERVA = "key string, video_id string, question string, " + ", ".join(f"answer_choice_{i} string" for i in range(12)) + ", answer_choices array<string>, answer_id int, answer string, question_type array<string>"
_OPTION = r"^\(([A-H])\)\s*(.*)$"


def stem_and_options(text: Column) -> Column:
    """(stem, options) of lines of text, options being lines ``(A) ...`` and what follows each."""
    lines = F.split(text, "\n")
    first = F.size(F.array_compact(F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.when(F.exists(F.slice(lines, 1, i), lambda x: F.trim(x).rlike(_OPTION)), i))))
    head = F.size(lines) - first
    body = F.slice(lines, head + 1, F.greatest(first, F.lit(0)))
    grown = F.aggregate(
        body,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.trim(x).rlike(_OPTION), F.concat(acc, F.array(F.trim(F.regexp_extract(F.trim(x), _OPTION, 2))))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), F.trim(x))))
        ),
    )
    return F.struct(F.trim(F.array_join(F.slice(lines, 1, head), "\n")).alias("stem"), F.when(first > 0, grown).otherwise(F.array().cast("array<string>")).alias("options"))


def lvbench(records: DataFrame) -> DataFrame:
    """Questions of records with schema ``LVBENCH``."""
    q = records.select("key", F.posexplode("qa").alias("n", "qa")).withColumn("s", stem_and_options(F.col("qa.question")))
    uid = F.coalesce("qa.uid", F.col("n").cast("string"))
    return q.select(F.lit("lvbench").alias("benchmark"), F.concat(F.lit("lvbench-"), "key", F.lit("-"), uid).alias("id"), F.col("key").alias("video_key"), F.col("s.stem").alias("question"), "s.options", F.upper(F.trim("qa.answer")).alias("answer"), F.coalesce("qa.question_type", F.array().cast("array<string>")).alias("task_types"), F.col("qa.time_reference").alias("time_reference"))


def minerva(records: DataFrame) -> DataFrame:
    """Questions of records with schema ``MINERVA``; the answer is a letter, A where it isn't among the choices."""
    each = F.array_compact(F.array(*[F.col(f"answer_choice_{i}") for i in range(12)]))
    choices = F.coalesce("answer_choices", F.when(F.size(each) > 0, each), F.when(F.col("answer").isNotNull(), F.array("answer")), F.array().cast("array<string>"))
    at = F.coalesce("answer_id", F.greatest(F.array_position(choices, F.coalesce("answer", F.lit(""))) - 1, F.lit(0)))
    none = F.lit(None).cast("string")
    return records.where("question is not null").select(F.lit("minerva").alias("benchmark"), F.concat(F.lit("minerva-"), "key").alias("id"), F.col("video_id").alias("video_key"), "question", choices.alias("options"), F.chr(at + 65).alias("answer"), F.coalesce("question_type", F.array().cast("array<string>")).alias("task_types"), none.alias("time_reference"))


def one_hour(records: DataFrame) -> DataFrame:
    """Questions of records of text columns, those it knows by any case of their names; options are parted by ``|``."""
    have = {c.lower(): c for c in records.columns}

    def get(*names: str) -> Column:
        return F.coalesce(*[F.col(f"`{have[n]}`") for n in names if n in have], F.lit(None).cast("string"))

    parted = F.transform(F.split(F.coalesce(get("options"), F.lit("")), r"\|"), lambda x: F.trim(x))
    letter = F.nullif(F.substring(F.upper(F.trim(F.coalesce(get("answer"), F.lit("")))), 1, 1), F.lit(""))
    key, asked = F.coalesce(get("video url", "video_id", "video_url"), F.lit("")), F.coalesce(get("question"), F.lit(""))
    return records.select(F.lit("onehour_videoqa").alias("benchmark"), F.concat(F.lit("onehour-"), F.substring(F.sha2(F.concat_ws("|", key, asked), 256), 1, 16)).alias("id"), key.alias("video_key"), asked.alias("question"), F.filter(parted, lambda x: x != "").alias("options"), letter.alias("answer"), F.array_compact(F.array(get("capability"))).alias("task_types"), F.lit(None).cast("string").alias("time_reference"))


def read(spark: SparkSession, benchmark: str, path: str) -> DataFrame:
    """Questions of a benchmark's files under a path."""
    if benchmark == "lvbench":
        return lvbench(spark.read.schema(LVBENCH).json(path))
    if benchmark == "minerva":
        return minerva(spark.read.schema(MINERVA).json(path, multiLine=True))
    if benchmark == "onehour_videoqa":
        return one_hour(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    raise ValueError(f"unknown benchmark {benchmark}")
