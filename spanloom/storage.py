"""Where operators put tables between stages.

Iterative operators must cut lineage. They write Parquet below the folder the cluster names in
``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a re-read and nothing more.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh temporary folder only for local masters where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(_remove_tree, _LOCAL[app].removeprefix("file://"))
    return _LOCAL[app]


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Stored:
    """A written table and the means to drop it once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def drop(self) -> None:
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, label: str) -> Stored:
    """Writes ``df`` to the shared folder and reads it back, which ends its lineage.

    The tables of an application lie in one folder named after it, which can go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Stored(spark, path)
