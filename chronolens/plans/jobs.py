"""Job checkpoints and cache markers: small files written aside and renamed, on any file system that Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """Whole small files by name under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._copy = jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray
        self._data = jvm.java.io.DataInputStream
        self.fs.mkdirs(self._path(self.root))
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if "://" in self.root else self.fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def put(self, name: str, text: str) -> None:
        """Write aside, then rename: a reader sees the old file or the new, never a part."""
        aside, at = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        # one step that takes the old file's place, where ``FileSystem.rename`` would not
        self.context.rename(aside, at, self._over)

    def get(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}")
        if not self.fs.exists(at):
            return None
        stream = self._data(self.fs.open(at))
        try:
            return bytes(self._copy(stream)).decode()
        finally:
            stream.close()


def save(files: Files, job: str, stages: dict[str, dict]) -> None:
    """A job's stages: state, rows done and failed, latest time."""
    files.put(f"job-{job}.json", json.dumps({"job": job, "stages": stages}, sort_keys=True))


def load(files: Files, job: str) -> dict[str, dict]:
    text = files.get(f"job-{job}.json")
    return json.loads(text)["stages"] if text else {}


def mark(files: Files, key: str, done: int, failed: int, skipped: int) -> bool:
    """Mark a stage as cached, if all of it was done."""
    if failed or skipped:
        return False
    files.put(f"cache-{key}", json.dumps({"done": done}))
    return True


def marked(files: Files, keys: list[str]) -> set[str]:
    return {k for k in keys if files.get(f"cache-{k}") is not None}


def index_state(stages: dict[str, dict], fine: tuple[str, ...]) -> str:
    """A video's state after a run: failed if a stage did, fine if all fine stages are done, else coarse."""
    if any(s.get("state") == "failed" for s in stages.values()):
        return "failed"
    return "fine" if fine and all(stages.get(f, {}).get("state") == "done" for f in fine) else "coarse"
