"""Session set-up and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "sparkprep", **conf) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir`` (or set by ``setCheckpointDir``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sparkprep-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[str] = []


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from the written copy.

    Used where one result feeds several branches that must agree row by row (positions, offsets) or where a loop would
    grow its plan. The copy survives the loss of executors, is columnar (later branches read only what they need), and
    stays in the shared folder until ``drop_copies`` or that folder's own clean-up.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkprep-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_copies(spark: SparkSession) -> int:
    """Delete the copies ``cut`` wrote in this process, once the results built on them are saved. Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped
