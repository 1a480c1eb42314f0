"""Streams: the stateless operators of this library take streaming tables as they are; here are their ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import c, require
from sparkprep.operators.aggregate import FUNCTIONS, aggregate
from sparkprep.session import shared_folder

_BATCH = "_batch"


def stream_files(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None, **options
) -> DataFrame:
    """The files of a folder, as they arrive."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def run_available(
    df: DataFrame, path: str | None = None, checkpoint: str | None = None, fmt: str = "parquet", mode: str = "append",
    timeout: int | None = None,
) -> str:
    """Process all that has arrived, write it to ``path`` (default: a new folder in the shared folder), and stop.

    The checkpoint makes the next run go on from there, and each file is written exactly once. A run that is not done
    within ``timeout`` seconds is stopped and raises TimeoutError: what it has written so far is not all.
    """
    base = f"{shared_folder(df.sparkSession)}/sparkprep-stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"
    query = (
        df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream was not done after {timeout} s; a run with checkpoint={checkpoint!r} goes on from there")
    return path


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """Give every micro-batch that is available to the user's function, and stop."""
    checkpoint = checkpoint or f"{shared_folder(df.sparkSession)}/sparkprep-stream-{uuid.uuid4().hex}/checkpoint"
    query = (
        df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_updates(df: DataFrame, keys: Iterable[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all that has arrived and return the latest row of each of ``keys``, open windows included.

    Each micro-batch writes the rows it changed to a folder of its own under ``path`` (default: a new one in the shared
    folder), which a batch that is run again replaces; a run with the same path and checkpoint goes on from there.
    """
    spark, names = df.sparkSession, require(df, keys)
    base = f"{shared_folder(spark)}/sparkprep-stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn(_BATCH, F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/part={batch}")

    run_batches(df, keep, checkpoint, mode="update")
    written = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_BATCH, T.LongType())])).option("recursiveFileLookup", "true").parquet(path)
    row = F.struct(*[c(n) for n in df.columns])
    latest = written.groupBy(*[c(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(F.max_by(row, F.col(_BATCH)).alias("_row"))
    return latest.select("_row.*")


def deduplicate_stream(df: DataFrame, keys: Iterable[str], time: str, delay: str) -> DataFrame:
    """One row per key; keys are forgotten once the watermark (``delay`` behind the latest ``time``) passes them.

    A time without zone is read in the time zone of the session, and given back so.
    """
    names, kind = require(df, keys), df.schema[time].dataType
    timed = df.withColumn(time, c(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(names).withColumn(time, c(time).cast(kind))


def aggregate_stream(
    df: DataFrame, by: Iterable[str] | None, operations: Iterable[tuple[str, str]], time: str, window: str, delay: str
) -> DataFrame:
    """The aggregates of operators.aggregate that can be merged, per time window of length ``window``.

    Watermarks need instants, so a time without zone is read in the time zone of the session, and given back so.
    """
    names, operations = require(df, by), list(operations)
    wrong = [f for _, f in operations if f not in FUNCTIONS or f in ("nunique", "median", "first", "last")]
    if wrong:
        raise ValueError(f"not available on streams: {wrong}")
    kind = df.schema[time].dataType
    timed = df.withColumn(time, c(time).cast("timestamp"))
    windowed = timed.withWatermark(time, delay).withColumn("_window", F.window(c(time), window))
    result = aggregate(windowed, ["_window", *names], operations)
    rest = [c(n) for n in result.columns if n != "_window"]
    ends = [F.col(f"_window.{e}").cast(kind).alias(f"window_{e}") for e in ("start", "end")]
    return result.select(*ends, *rest)
