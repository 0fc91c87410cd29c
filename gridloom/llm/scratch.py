"""Written tables in the folder that all executors share.

Iterative operators cut their lineage here. The folder is the one that the
cluster names in ``spark.checkpoint.dir``; only in local mode, where none is named,
a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, as a URI or path."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    # with its scheme: a path without one means the default file system, not each executor's disk
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)).rstrip("/")


class Scratch:
    """Tables of one run of an operator; codec: Parquet's, the session's if none."""

    def __init__(self, spark: SparkSession, name: str, codec: str | None = None):
        self.spark = spark
        self._options = {"compression": codec} if codec else {}
        self.root = f"{shared_folder(spark)}/gridloom/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: later stages start from the files."""
        path, schema = self.path(name), df.schema
        df.write.mode("overwrite").options(**self._options).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._gridloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove the files behind a table of ``keep`` that nothing reads any more."""
        self.remove(df._gridloom_path)

    def remove(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
