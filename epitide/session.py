"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: scratch folders of this process, for :func:`clear_scratch`
_made: list[str] = []


def session(app: str = "epitide", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` and ``partitions`` to the submit command.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder of the cluster (``spark.checkpoint.dir``).

    Only where that setting is absent and the master is local, as in tests, a local folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="epitide-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the scratch folders that this process made; tables that still read them become invalid."""
    context = spark.sparkContext
    removed = 0
    while _made:
        path = context._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    The written table ends the lineage: later stages survive the loss of executors, and
    every use of the result sees the same rows in the same layout.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
