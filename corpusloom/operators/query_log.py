"""Query-log records and the reports over them."""

from pyspark.sql import Column, DataFrame, functions as F


def shape(records: DataFrame, now: Column, keep_question: bool = True) -> DataFrame:
    """Fill a missing timestamp; swap the question for its hash when raw text is off."""
    if "timestamp" in records.columns:
        out = records.withColumn("timestamp", F.coalesce("timestamp", now))
    else:
        out = records.withColumn("timestamp", now)
    if keep_question:
        return out
    digest = F.sha2(F.col("question"), 256)
    known = F.coalesce("question_hash", F.lit(None).cast("string")) if "question_hash" in out.columns else F.lit(None).cast("string")
    return out.withColumn("question_hash", F.coalesce(digest, known)).drop("question")


def derive(answers: DataFrame) -> DataFrame:
    """Log columns of answered questions; seconds are rounded to milliseconds, empty errors left out.

    ``answers``: question, retrieved_docs, context_chars, source_count, finish_reason, the three durations, answer_chars, error.
    """
    renamed = {"context_chars": "prompt_chars"}
    return answers.withColumns({
        "question_chars": F.length(F.coalesce("question", F.lit(""))),
        "prompt_chunks": F.col("retrieved_docs"),
        "finish_reason": F.coalesce(F.nullif("finish_reason", F.lit("")), F.lit("end")),
        "generation_seconds": F.round("generation_seconds", 3),
        "retrieval_seconds": F.round("retrieval_seconds", 3),
        "total_seconds": F.round("total_seconds", 3),
        "error": F.nullif("error", F.lit("")),
    }).withColumnsRenamed(renamed)


# profile columns that a log record keeps
PROFILE_COLUMNS = ["vector_top_k", "keyword_top_k", "jira_top_k", "expand_chunks", "max_context_chars"]


def with_context(records: DataFrame, questions: DataFrame, mentions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Records with what retrieval decided; a record without a retrieval has none of it.

    ``records`` and ``questions`` have query_id; ``questions`` brings route, route_reason and the profile columns,
    ``mentions`` (query_id, mention_no, source_type, space) the resolved scopes, ``chosen`` (query_id, long_document_mode,
    chunk_index) the chunks of a long document.
    """
    scopes = mentions.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("mention_no", "source_type", "space"))).alias("_m")).select(
        "query_id", F.transform("_m", lambda m: F.struct(m["source_type"].alias("source_type"), m["space"].alias("space"))).alias("_mentions"))
    long_ = chosen.filter(F.col("long_document_mode") != "none").groupBy("query_id").agg(
        F.max("long_document_mode").alias("long_document_mode"), F.count("*").cast("int").alias("document_chunk_count"),
        F.array_sort(F.collect_set("chunk_index")).alias("selected_chunk_indexes"))
    none = F.array().cast("array<struct<source_type: string, space: string>>")
    decided = questions.select("query_id", "route", "route_reason", *PROFILE_COLUMNS).join(scopes, "query_id", "left").join(long_, "query_id", "left")
    decided = decided.withColumn("mentions", F.coalesce("_mentions", none)).drop("_mentions")
    return records.join(decided, "query_id", "left")


def route_statistics(records: DataFrame, keys: list | None = None) -> DataFrame:
    """Count, mean seconds and mean prompt chunks per route; absent numbers count as 0."""
    route = F.coalesce("route", F.lit("unknown")).alias("route")
    return records.groupBy(*(keys or []), route).agg(
        F.count("*").alias("records"),
        F.avg(F.coalesce(F.col("total_seconds").cast("double"), F.lit(0.0))).alias("avg_seconds"),
        F.avg(F.coalesce(F.col("prompt_chunks").cast("int"), F.lit(0))).alias("avg_prompt_chunks"))


def question_name() -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ("question", "question_hash")], F.lit("(hidden)"))


def most_common(records: DataFrame, value: Column, limit: int = 20) -> DataFrame:
    """Most frequent values, ties by value."""
    return records.groupBy(value.alias("value")).agg(F.count("*").alias("records")).orderBy(
        F.desc("records"), "value").limit(limit)


def top_questions(records: DataFrame, limit: int = 20) -> DataFrame:
    return most_common(records, question_name(), limit)


def finish_reasons(records: DataFrame, limit: int = 20) -> DataFrame:
    return most_common(records, F.coalesce("finish_reason", F.lit("unknown")), limit)
