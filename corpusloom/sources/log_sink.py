"""Appending query-log records by day, and dropping old days."""

from datetime import date, timedelta
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import fixed_values as fv


def log_day(timestamp: Column) -> Column:
    """The local date written in the record's own offset."""
    return F.substring(timestamp, 1, 10)


def _store(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _ledger(directory: str, stream: str, batch: str) -> str:
    return f"{directory.rstrip('/')}/_ledger/stream={stream}/batch={batch}"


def append_once(records: DataFrame, directory: str, stream: str, batch: str) -> None:
    """Append a batch of a stream to its days, exactly once however often it is tried.

    Rows go to ``log_date=<day>/stream=<stream>/batch=<batch>`` folders, which a repeated attempt replaces; an entry in the
    ledger is written last. Readers take only batches of the ledger, so a half-written day is never seen.
    """
    spark = records.sparkSession
    store, done = _store(spark, _ledger(directory, stream, batch))
    if store.exists(done):
        return
    rows = records.withColumns({"log_date": log_day(F.col("timestamp")), "stream": F.lit(stream), "batch": F.lit(batch)})
    # dealt by row, so a batch that comes in few splits, or for one day, is not sorted by day in one task
    rows = rows.repartition(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "stream", "batch").json(directory)
    store.create(done, True).close()


def append(records: DataFrame, directory: str, batch: str | None = None, stream: str = "direct") -> bool:
    """Append records to their day; a failed write is reported, never raised. A retry under the same ``batch`` adds nothing."""
    try:
        append_once(records, directory, stream, batch or uuid4().hex)
        return True
    except Exception as error:  # logging must not stop the caller
        print(f"query log write failed: {error}")
        return False


def append_stream(records: DataFrame, directory: str, stream: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's new records once, then stop; its batches keep their numbers over restarts."""
    query = records.writeStream.foreachBatch(lambda batch, number: append_once(batch, directory, stream, str(number))).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_log(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """The records of all batches of the ledger as it is now, with their ``log_date``."""
    store, folder = _store(spark, f"{directory.rstrip('/')}/_ledger")
    entries = [(s.getPath().getName().removeprefix("stream="), b.getPath().getName().removeprefix("batch="))
               for s in (store.listStatus(folder) if store.exists(folder) else []) for b in store.listStatus(s.getPath())]
    ledger = spark.createDataFrame(entries, "stream string, batch string")
    if not day_folders(spark, directory):
        return spark.createDataFrame([], f"{schema}, log_date string")
    rows = spark.read.schema(f"{schema}, log_date string, stream string, batch string").json(directory)
    return rows.join(ledger, ["stream", "batch"], "left_semi").drop("stream", "batch")


def within_retention(records: DataFrame, now: Column, days: int) -> DataFrame:
    """Records of the last ``days`` days; 0 or less keeps all. ``timestamp`` is a timestamp column."""
    return records if days <= 0 else records.filter(F.col("timestamp") >= now - F.make_interval(days=F.lit(days)))


def day_folders(spark: SparkSession, directory: str) -> list[str]:
    """The days that have a folder; names only, no file is opened."""
    store, path = _store(spark, directory)
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(n.removeprefix("log_date=") for n in names if n.startswith("log_date="))


def expired_days(spark: SparkSession, directory: str, today: str, days: int = fv.LOG_RETENTION_DAYS) -> list[str]:
    """Days older than the last ``days`` days; 0 or less keeps all."""
    first = (date.fromisoformat(today) - timedelta(days=days)).isoformat()
    return [d for d in day_folders(spark, directory) if d < first] if days > 0 else []


def drop_expired(spark: SparkSession, directory: str, today: str, days: int = fv.LOG_RETENTION_DAYS) -> list[str]:
    """Remove the folders of expired days; returns the removed days."""
    gone = expired_days(spark, directory, today, days)
    for day in gone:
        store, path = _store(spark, f"{directory.rstrip('/')}/log_date={day}")
        store.delete(path, True)
    return gone
