"""What a session needs before operators that run Python on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: threads of the driver that hand on exchanges, where the session names no limit of its own. Spark's pools make a new one for every exchange, up to
#: 1,024, and keep it for a minute: operators of many small steps would hold hundreds
THREADS = {"spark.sql.shuffleExchange.maxThreadThreshold": "16", "spark.sql.resultQueryStage.maxThreadThreshold": "16", "spark.sql.broadcastExchange.maxThreadThreshold": "32"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process, as in tests, is a
    temporary folder made, once a session; on a cluster it would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_chronolens_shared", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronolens-")
        spark.sparkContext._chronolens_shared = found
    return found.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: they need not have it installed. Limit the driver's threads."""
    context = spark.sparkContext
    if getattr(context, "_chronolens_sent", False):
        return
    _few_threads(spark)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="chronolens-"), "chronolens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    context.addPyFile(path)
    context._chronolens_sent = True


def _few_threads(spark: SparkSession) -> None:
    """Set ``THREADS``. Each pool reads its limit when the first query needs it; in a session that has run queries before nothing changes."""
    own, conf = spark.sparkContext.getConf(), spark._jsparkSession.sessionState().conf()
    for k, v in THREADS.items():
        if not own.contains(k):
            conf.setConfString(k, v)
