"""Session defaults for this engine; a cluster's own settings win where they are given."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tomewright", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time and adaptive execution; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """SRC-1, SRC-2: one table of a data folder, read as Parquet so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path that the driver and all executors see, under ``spark.checkpoint.dir``, removed with the session.

    Where that is unset, a temporary folder serves a local master only.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tomewright-")
    path = f"{root.rstrip('/')}/tomewright/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: what several branches of a plan read is computed once."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def compact(spark: SparkSession, source: str, target: str, bytes_per_file: int = 256 << 20) -> DataFrame:
    """SNK-11: a table written anew in files of about one size: what a vacuum does for plain files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    rows = spark.read.parquet(source)
    rows.repartition(max(1, -(-size // bytes_per_file))).write.mode("errorifexists").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)
