"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode, else RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="linkweave-shared-")
    return _OWN[app]


def small_batches(spark: SparkSession) -> None:
    """Batches of some MB between the JVM and Python, unless the session asks for another size than the default.

    Spark reads this setting from the session when a plan runs, so it holds for the session's later queries too; a size
    that the user has set stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


class Scratch:
    """Written tables and files of one operator run; removed at the end of the process, or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once, so that later steps and retries read it instead of its lineage."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _clean(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop("")
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``, from file sizes; no job runs. Rows that no file holds count by partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else df.rdd.getNumPartitions() << 24


def shards(df: DataFrame, per: int, least: int = 8) -> int:
    """So many shards that each holds about ``per`` bytes of the stored input."""
    session = df.sparkSession
    small_batches(session)
    return max(least, int(session.conf.get("spark.sql.shuffle.partitions", "8")), -(-plan_bytes(df) // per))
