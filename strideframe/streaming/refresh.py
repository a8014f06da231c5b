"""Incremental counts: new origins arrive as files, only those without counts are searched."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strideframe.operators.reach import merge_counts, missing_origins, reach, reach_counts
from strideframe.storage import written

COUNTS = "origin long, category string, n long"


def cached_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What earlier batches left: a row with a null category marks an origin without any amenity."""
    try:
        return spark.read.schema(COUNTS).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], COUNTS)


def add_missing(origins: DataFrame, edges: DataFrame, nodes: DataFrame, weights: DataFrame, folder: str, cutoff: float) -> None:
    """Searches the origins that the folder lacks and appends their counts: a batch that is repeated adds nothing."""
    spark = origins.sparkSession
    todo = written(missing_origins(origins, cached_counts(spark, folder)), "todo")
    counts = reach_counts(reach(todo, edges, nodes, cutoff), weights)
    none = todo.select(F.col("node_id").alias("origin")).join(counts.select("origin").distinct(), "origin", "left_anti").select("origin", F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("n"))
    counts.select("origin", "category", F.col("n").cast("long").alias("n")).unionByName(none).write.mode("append").parquet(folder)


def refresh_stream(spark: SparkSession, arrivals: str, edges: DataFrame, nodes: DataFrame, weights: DataFrame, folder: str, cutoff: float, checkpoint: str) -> StreamingQuery:
    """Takes all files of origins (node_id) that have arrived, batch by batch, and ends."""
    stream = spark.readStream.schema("node_id long").parquet(arrivals)
    return stream.writeStream.foreachBatch(lambda batch, _: add_missing(batch, edges, nodes, weights, folder, cutoff)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, folder: str, new: DataFrame) -> DataFrame:
    return merge_counts(cached_counts(spark, folder).where("category IS NOT NULL"), new)
