"""Run logs as streams: append-only JSON lines, read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "run_id string, epoch int, phase int, global_step bigint, score double, logged_at timestamp"


def log_stream(spark: SparkSession, path: str, schema: str = LINE, files_per_batch: int = 100) -> DataFrame:
    """Lines of a folder of JSON-lines files; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once_each(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Lines without those sent again within the delay; state is dropped behind the watermark."""
    return lines.withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["run_id", "epoch"])


def best_so_far(lines: DataFrame) -> DataFrame:
    """Best score per run and the first epoch that reached it; for complete or update mode."""
    best = F.max(F.struct("score", (-F.col("epoch")).alias("e"))).alias("b")
    return lines.filter("score is not null").groupBy("run_id").agg(best, F.count("*").alias("epochs")).select("run_id", F.col("b.score").alias("best_score"), (-F.col("b.e")).alias("best_epoch"), "epochs")


def hourly(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Lines and mean score per hour; an hour closes when the watermark has passed it."""
    return lines.withWatermark("logged_at", delay).groupBy(F.window("logged_at", "1 hour")).agg(F.count("*").alias("lines"), F.avg("score").alias("mean_score")).select("window.start", "lines", "mean_score")
