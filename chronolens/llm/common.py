"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ready

TOKENIZER_FILE = "byte_bpe_50k.json"


#: what one Arrow batch may hold, where the session names no limits of its own
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def small_batches(spark: SparkSession) -> None:
    """Make the session ready. Batches between the JVM and Python of a few MB: long texts must not add up to a worker's memory."""
    ready(spark)
    if not getattr(spark, "_chronolens_batches", False):
        own = spark.sparkContext.getConf()
        for k, v in BATCH.items():
            if not own.contains(k):
                spark.conf.set(k, v)
        spark._chronolens_batches = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process, as in tests, is a
    temporary folder made, once a session; on a cluster it would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_chronolens_shared", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronolens-")
        spark.sparkContext._chronolens_shared = found
    return found.rstrip("/")


#: tables of this process that are still there, with what deletes each
_LEFT: dict[str, tuple] = {}


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts lineage and survives lost executors.

    It is deleted by ``dropped``, or else when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronolens_path = path
    return out


def named(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, known to ``dropped`` by the table ``source`` that it reads."""
    df._chronolens_path = getattr(source, "_chronolens_path", None)
    return df


def _deleted(path: str) -> None:
    jvm, conf = _LEFT.pop(path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_chronolens_path", None)
    if path in _LEFT:
        _deleted(path)


@atexit.register
def _swept() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the JVM may have gone first
            _deleted(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of tables that are no longer referred to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
