"""Reading cases stored as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cases(spark: SparkSession, folder: str, schema: str, identity: str) -> DataFrame:
    """The first case of each identity over the files of ``folder`` by name; an absent folder has none, a broken file adds none.

    Each file holds one JSON array. Cases without an identity are all kept.
    """
    try:
        read = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    placed = read.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")).alias("_at"))
    own = F.coalesce(F.col(identity).cast("string"), F.to_json("_at"))
    first = placed.groupBy(own.alias("_own")).agg(F.min_by(F.struct(*read.columns), "_at").alias("_c"))
    return first.select("_c.*")
