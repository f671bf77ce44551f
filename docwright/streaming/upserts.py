"""Incremental work on arriving files: each micro-batch is classified and laid over a state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docwright.operators import merges

#: States that stay in the folder.
KEPT = 3


def latest(spark: SparkSession, folder: str, last: int) -> DataFrame | None:
    """The state of the newest batch up to ``last``, if there is one."""
    try:
        held = spark.read.parquet(folder)
    except AnalysisException:
        return None
    newest = held.filter(F.col("batch") <= last).agg(F.max("batch")).first()[0]
    return None if newest is None else held.filter(F.col("batch") == newest).drop("batch")


def upserting(folder: str, key: str, digest: str, number: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. A batch that is run again starts from the same earlier state and overwrites its own."""

    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        one = merges.keep_first(rows, [key], [F.col(digest)])
        before = latest(spark, folder, batch - 1)
        if before is None:
            before = one.limit(0).withColumn(number, F.lit(0).cast("bigint"))
        merges.upsert(before, one, key, digest, number).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        drop_before(spark, folder, batch - KEPT + 1)

    return apply


def drop_before(spark: SparkSession, folder: str, first: int) -> None:
    """Delete the states of batches before ``first``; the last ones stay, as a batch may be run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for held in files.listStatus(path):
        name = held.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < first:
            files.delete(held.getPath(), True)


def run(rows: DataFrame, folder: str, checkpoint: str, key: str, digest: str, number: str = "number") -> StreamingQuery:
    """Work off everything that has arrived, then stop."""
    return (
        rows.writeStream.foreachBatch(upserting(folder, key, digest, number)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
