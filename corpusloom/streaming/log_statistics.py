"""Route statistics as a stream over query-log records."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.query_log import route_statistics


def daily_routes(records: DataFrame) -> DataFrame:
    """Route statistics per day of event time; ``timestamp`` is a timestamp column.

    There is no watermark: a day counts its records however late they come. The state is one row per day and route.
    """
    return route_statistics(records, [F.window("timestamp", "1 day").alias("day")])


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def run_once(statistics: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Bring a statistics table up to date with everything that has landed, then stop.

    Each batch holds the whole new value of every (day, route) that changed. It is joined by the other routes of these days, whose
    partitions are then replaced, so a replayed batch changes nothing; other days are not read.
    """
    rows = statistics.select(F.to_date("day.start").cast("string").alias("day"), "route", "records", "avg_seconds", "avg_prompt_chunks")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, table):
            old = spark.read.schema(batch.schema).parquet(table)
            kept = old.join(batch.select("day").distinct(), "day", "left_semi").join(batch, ["day", "route"], "left_anti")
            batch = batch.unionByName(kept)
        staged = f"{checkpoint}-staged/{batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        spark.read.schema(batch.schema).parquet(staged).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)

    query = rows.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return query
