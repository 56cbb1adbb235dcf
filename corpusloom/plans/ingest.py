"""Landed pages and issues to the chunk table: parse, prepare, cut, and replace each source's snapshot."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom import fixed_values as fv
from corpusloom.operators import issues, prepare
from corpusloom.sources import landed, snapshot
from corpusloom.sources.schemas import CHUNK


@dataclass(frozen=True)
class Place:
    """A wiki space or a tracker project, and where its links lead.

    To ingest many at once, land each in a folder ``<column>=<key>`` and give that column as ``key``: all are read together.
    """

    key: str | Column
    name: str | Column = ""
    site: str = ""
    base: str = ""


def issue_overviews(spark: SparkSession, path: str, place: Place, fields: DataFrame, newest: int | None = None) -> DataFrame:
    """Overviews of a project's landed issues; ``fields`` (id, name) names their custom fields."""
    rows = landed.issues(spark, path, place.key, newest)
    named = issues.custom_fields(rows, fields, fv.CUSTOM_FIELD_CHARS)
    return issues.overview(rows.withColumnRenamed("raw_comments", "comments").drop("custom").join(named, "key", "left"))


def issue_chunks(overviews: DataFrame, place: Place) -> DataFrame:
    """Chunks of the issues and of their project's status summary."""
    own, summary = issues.issue_chunks(overviews, place.site), issues.summary_chunks(issues.project_summary(overviews), place.site)
    return own.unionByName(summary, allowMissingColumns=True)


def page_chunks(spark: SparkSession, path: str, place: Place, overviews: DataFrame | None = None,
                projects: DataFrame | None = None) -> DataFrame:
    """Chunks of a space's landed pages; links to issues and projects get their labels."""
    pages = prepare.with_location(landed.pages(spark, path), place.key, place.name, place.site, place.base)
    labels = None
    if overviews is not None and projects is not None:
        lines = F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["text"]))
        labels = prepare.link_labels(pages, overviews.select("key", "summary", F.col("status_name").alias("status"), lines.alias("custom")), projects)
    return prepare.page_chunks(prepare.page_text(pages, labels))


def conformed(chunks: DataFrame) -> DataFrame:
    """Exactly the columns of the chunk table, absent ones null."""
    fields = [f.strip().split(" ", 1) for f in CHUNK.replace("\n", " ").split(", ")]
    return chunks.select(*[(F.col(n) if n in chunks.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields])


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "500"


def publish(chunks: DataFrame, table: str, run_id: str, sources: DataFrame | None = None) -> None:
    """Replace the snapshots of ``sources`` (source_type, space), also of those that came out empty, by this run.

    Pages are long and pass several Python steps, each of which holds a batch: batches are small here.
    """
    conf = chunks.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, ROWS)
    try:
        snapshot.replace_source(conformed(chunks), table, run_id, sources)
    finally:
        conf.set(BATCH, before)
