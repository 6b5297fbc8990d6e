"""Session helpers: a tuned builder, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(app: str = "linkweave", cores: str | int = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and UTC time, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="linkweave-work-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keeper(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table once, in a new folder that all share; what reads it has a plan without its lineage."""
    root = work_dir(spark, name)

    @atexit.register
    def clean() -> None:
        context = spark.sparkContext
        if context._jsc is not None:  # else the session has ended
            place = context._jvm.org.apache.hadoop.fs.Path(root)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

    def keep(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{root}/{part}")
        return spark.read.schema(df.schema).parquet(f"{root}/{part}")

    return keep


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="linkweave-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
