"""Where rows and small files are kept that a later job, or another machine, must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only for a session on one machine that sets none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanveil-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new place below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Files:
    """Small files in whatever store Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def exists(self, at: str) -> bool:
        return self.fs.exists(self._path(at))

    def read(self, at: str) -> bytes:
        stream = self.fs.open(self._path(at))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, at: str, data: bytes) -> bool:
        """Writes a file that only its owner reads; false if there is one already."""
        if self.exists(at):
            return False
        try:
            stream = self.fs.create(self._path(at), False)
        except Exception:
            if self.exists(at):  # another writer was first
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        self.fs.setPermission(self._path(at), self.jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        return True

    def delete(self, at: str) -> bool:
        return self.fs.delete(self._path(at), True)

    def names(self, at: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(at))) if self.exists(at) else []
