"""Indexed sources, their run history and searches over the source catalogue."""

from pyspark.sql import DataFrame, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import blank_to_null
from corpusloom.operators.ranking import numbered
from corpusloom.operators.scope import source_type


def source_statistics(chunks: DataFrame) -> DataFrame:
    """Chunk count and first known name per source."""
    name = blank_to_null(F.col("space_name"))
    return chunks.filter(blank_to_null(F.col("space")).isNotNull()).groupBy(
        source_type().alias("source_type"), "space").agg(
        F.count("*").alias("chunks"), F.min_by(name, F.when(name.isNotNull(), F.col("chunk_id"))).alias("space_name"))


def merge_history(runs: DataFrame, restored: DataFrame) -> DataFrame:
    """Latest run per source over the restored rows; a missing name comes from the restored row.

    ``runs``: source_type, space, space_name, chunks, status, run_at; ``restored``: source_type, space, space_name, chunks.
    """
    keys = ["source_type", "space"]
    latest = runs.withColumn("source_type", source_type()).groupBy(*keys).agg(
        F.max_by(F.struct("space_name", "chunks", "status"), "run_at").alias("run")).select(*keys, "run.*")
    r = restored.withColumn("source_type", source_type()).select(
        *keys, F.col("space_name").alias("_name"), F.col("chunks").alias("_chunks"))
    return latest.join(r, keys, "full").select(
        *keys, F.coalesce(blank_to_null(F.col("space_name")), "_name").alias("space_name"),
        F.coalesce("chunks", "_chunks").alias("chunks"), F.coalesce("status", F.lit("indexed")).alias("status"))


def reindex_targets(history: DataFrame) -> DataFrame:
    """Distinct known sources of a valid type."""
    typed = history.withColumn("source_type", source_type())
    usable = typed.filter(blank_to_null(F.col("space")).isNotNull() & F.col("source_type").isin(fv.WIKI, fv.TRACKER))
    return usable.groupBy("source_type", "space").agg(F.min("space_name").alias("space_name"))


def run_results(targets: DataFrame, outcomes: DataFrame, slot: str) -> DataFrame:
    """One row per source of a run; a target without an outcome failed; one skipped row when there is no target.

    ``outcomes``: source_type, space, chunks, error.
    """
    keys = ["source_type", "space"]
    ran = targets.join(outcomes.withColumn("_ran", F.lit(True)), keys, "left")
    ok = F.coalesce(F.col("_ran"), F.lit(False)) & F.col("error").isNull()
    rows = ran.select(
        *keys, "space_name", F.when(ok, F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks"),
        F.when(ok, "success").otherwise("failed").alias("status"), "error", F.lit(slot).alias("schedule_slot"))
    none = targets.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("space"),
        F.lit(None).cast("string").alias("space_name"), F.lit(0).cast("long").alias("chunks"), F.lit("skipped").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(slot).alias("schedule_slot"))
    return rows.unionByName(none)


def run_totals(results: DataFrame) -> DataFrame:
    """Completed, failed and chunk totals per run."""
    failed = F.count_if(F.col("status") == "failed")
    return results.groupBy("schedule_slot").agg(
        F.count_if(F.col("status") != "skipped").alias("total"), F.count_if(F.col("status") == "success").alias("completed"),
        failed.alias("failed"), F.sum("chunks").alias("chunks"),
        F.when(failed > 0, "idle_with_errors").otherwise("idle").alias("run_status"))


def name_search(catalogue: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """First sources whose key or name holds the text, ignoring case. ``catalogue``: key, name, source_type."""
    wanted = query.strip().lower()
    name = F.coalesce(blank_to_null(F.col("name")), F.col("key"))
    rows = catalogue.select("key", name.alias("name"), "source_type")
    if not wanted:
        return rows.limit(0)
    hit = F.contains(F.lower("key"), F.lit(wanted)) | F.contains(F.lower("name"), F.lit(wanted))
    return rows.filter(hit).orderBy("key").limit(limit)


def interleave(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Round-robin of two already limited lists, ordered by key inside each."""
    def ranked(df, no):
        return df.withColumn("list_no", F.lit(no))

    both = numbered(ranked(first, 0).unionByName(ranked(second, 1)), ["list_no"], [F.col("key")])
    return both.orderBy("rank", "list_no").limit(limit)
