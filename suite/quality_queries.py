"""Evaluation metrics and query-log reports."""

from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import followup
from corpusloom.operators import context, evaluation, history, query_log
from corpusloom.operators.ranking import numbered
from corpusloom.storage import work_dir
from corpusloom.streaming import log_statistics
from suite import domain as d
from suite import sql as s
from suite.registry import query
from suite.retrieval_queries import packed, ranked_lengths
from suite.text_queries import format_sql

RANKING = {"case_id": "CAST(user_id AS STRING)", "page": "concat('p', CAST(event_id % 53 AS STRING))", "event_id": "event_id"}  # BOTH
RELEVANCE = {"case_id": "CAST(user_id AS STRING)", "page": "concat('p', CAST(event_id % 53 AS STRING))",
             "grade": "CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 4 AS INT) END"}  # BOTH
CASE = {"case_id": "CAST(user_id AS STRING)", "category": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('cat', CAST(user_id % 4 AS STRING)) END"}  # BOTH


def scores(spark, sf, baseline=False):
    """Cases per user: views (or clicks) are the ranking, purchases the relevant pages, errors the forbidden ones."""
    events = d.table(spark, sf, "events")
    rows = d.pick(events.filter(F.col("event_type") == ("click" if baseline else "view")), RANKING)
    rankings = numbered(rows, ["case_id"], [F.col("event_id")]).drop("event_id")
    relevance = d.pick(events.filter("event_type = 'purchase'"), RELEVANCE)
    forbidden = d.pick(events.filter("event_type = 'error' AND user_id % 3 = 0"), RELEVANCE).drop("grade")
    cases = d.pick(events, CASE).distinct()
    latency = events.groupBy(F.col("user_id").cast("string").alias("case_id")).agg(F.max("value").alias("latency_ms"))
    return evaluation.score_cases(cases.join(latency, "case_id"), rankings, relevance, forbidden, 5)


def score_ctes(name, kind):
    s.cte(f"{name}rank", f"SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS rank FROM (SELECT {d.both(d_rank)} FROM events WHERE event_type = '{kind}')")
    s.cte(f"{name}score", f"""
      SELECT c.case_id, c.category, c.latency_ms, coalesce(n, 0) AS relevant_count, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_k,
        CASE WHEN n > 0 THEN coalesce(found, 0)::DOUBLE / n ELSE 0 END AS recall_at_k, coalesce(found, 0)::DOUBLE / 5 AS precision_at_k,
        coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg_at_k,
        coalesce(bad, '') AS forbidden_pages, coalesce(bad, '') <> '' AS has_forbidden_scope
      FROM (SELECT {d.both(CASE)}, max(value) AS latency_ms FROM events GROUP BY 1, 2) c
      LEFT JOIN (SELECT case_id, count(*) FILTER (relevant) AS n FROM judged_ GROUP BY 1) j ON j.case_id = c.case_id
      LEFT JOIN (SELECT case_id, sum(grade / log2(i + 1)) AS ideal FROM (SELECT case_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC) AS i FROM judged_)
                 WHERE i <= 5 GROUP BY 1) g ON g.case_id = c.case_id
      LEFT JOIN (SELECT r.case_id, count(DISTINCT r.page) FILTER (relevant AND rank <= 5) AS found, min(rank) FILTER (relevant) AS first,
                   sum(CASE WHEN rank <= 5 THEN coalesce(grade, 0) / log2(rank + 1) ELSE 0 END) AS dcg
                 FROM {name}rank r LEFT JOIN judged_ q ON q.case_id = r.case_id AND q.page = r.page GROUP BY 1) x ON x.case_id = c.case_id
      LEFT JOIN (SELECT case_id, string_agg(page, ',' ORDER BY at_) AS bad FROM (SELECT r.case_id, r.page, min(rank) AS at_ FROM {name}rank r
                   JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS case_id, 'p' || (event_id % 53) AS page FROM events WHERE event_type = 'error' AND user_id % 3 = 0) f
                   ON f.case_id = r.case_id AND f.page = r.page WHERE rank <= 5 GROUP BY 1, 2) GROUP BY 1) b ON b.case_id = c.case_id""", f"{name}rank", "judged_")


d_rank = RANKING
s.cte("judged_", f"""
  SELECT case_id, page, CASE WHEN grade IS NULL THEN true ELSE grade > 0 END AS relevant, coalesce(grade, 1)::DOUBLE AS grade FROM (
    SELECT case_id, page, max(grade) AS grade FROM (SELECT {d.both(RELEVANCE)} FROM events WHERE event_type = 'purchase') GROUP BY 1, 2)""")
score_ctes("v_", "view")
score_ctes("b_", "click")


def _metric(name, column, sql_column=None):
    sql = s.build(f"SELECT case_id, round({sql_column or column}, 6) AS value FROM v_score", "v_score")

    @query(name, sql)
    def run(spark, sf):
        return scores(spark, sf).select("case_id", F.round(column, 6).alias("value"))


_metric("e1_hit_at_k", "hit_at_k")
_metric("e2_recall_at_k", "recall_at_k")
_metric("e3_precision_at_k", "precision_at_k")
_metric("e4_reciprocal_rank", "reciprocal_rank")
_metric("e5_ndcg_at_k", "ndcg_at_k")


@query("e6_forbidden_pages", s.build("SELECT case_id, forbidden_pages, has_forbidden_scope FROM v_score", "v_score"))
def forbidden_pages(spark, sf):
    return scores(spark, sf).select("case_id", F.array_join("forbidden_pages", ",").alias("forbidden_pages"), "has_forbidden_scope")


_cols = "hit_at_k, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_k, 6) AS ndcg_at_k"


@query("e7_case_scores", s.build(f"SELECT case_id, relevant_count, {_cols}, has_forbidden_scope FROM v_score", "v_score"))
def case_scores(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in ("recall_at_k", "precision_at_k", "reciprocal_rank", "ndcg_at_k")]
    return scores(spark, sf).select("case_id", "relevant_count", "hit_at_k", *rounded, "has_forbidden_scope")


_MEANS = ("count(*) AS case_count, round(avg(hit_at_k), 6) AS hit_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(precision_at_k), 6) AS precision_at_k, "
          "round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(CAST(has_forbidden_scope AS INT)), 6) AS forbidden_scope_rate, "
          "round(avg(latency_ms), 6) AS average_latency_ms")


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("e8_summary", s.build(f"SELECT {_MEANS} FROM v_score", "v_score"))
def summary(spark, sf):
    return _rounded(evaluation.summarise(scores(spark, sf)))


@query("e9_category_summary", s.build(f"""
SELECT coalesce(category, '') AS category, 0 AS level, {_MEANS} FROM v_score GROUP BY 1 UNION ALL SELECT NULL, 1, {_MEANS} FROM v_score""", "v_score"))
def category_summary(spark, sf):
    return _rounded(evaluation.summarise_by_category(scores(spark, sf)))


def _tall(alias):
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({'reciprocal_rank' if m == 'mrr' else m}) AS v FROM {alias}" for m in evaluation.METRICS)


@query("e10_baseline", s.build(f"""
SELECT c.metric, round(c.v, 6) AS current, round(b.v, 6) AS baseline, round(c.v - b.v, 6) AS delta FROM ({_tall('v_score')}) c JOIN ({_tall('b_score')}) b ON b.metric = c.metric""",
                             "v_score", "b_score"))
def baseline(spark, sf):
    now, before = evaluation.summarise(scores(spark, sf)), evaluation.summarise(scores(spark, sf, baseline=True))
    return _rounded(evaluation.compare_with_baseline(now, before))


@query("e11_target_rows", s.build("SELECT metric, label, round(value, 6) AS value, target FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{label}' AS label, avg({ {'mrr': 'reciprocal_rank', 'forbidden_scope_rate': 'CAST(has_forbidden_scope AS INT)'}.get(m, m) }) AS value, "
    f"{'0.8::DOUBLE' if m == 'hit_at_k' else 'NULL'} AS target FROM v_score" for m, label in evaluation.TARGET_LABELS.items()) + ")", "v_score"))
def target_rows(spark, sf):
    targets = spark.createDataFrame([("hit_at_k", 0.8)], "metric string, target double")
    return _rounded(evaluation.target_rows(evaluation.summarise(scores(spark, sf)), targets))


@query("e12_two_key_dedupe", """
WITH RECURSIVE v AS (SELECT CAST(user_id AS VARCHAR) AS case_id, 'p' || event_id % 9 AS page_id, 't' || event_id % 7 AS title,
                            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events),
f AS (SELECT case_id, rank, page_id, title, [page_id] AS pages, [title] AS titles, true AS kept FROM v WHERE rank = 1
      UNION ALL
      SELECT v.case_id, v.rank, v.page_id, v.title, CASE WHEN seen THEN pages ELSE list_append(pages, v.page_id) END,
             CASE WHEN seen THEN titles ELSE list_append(titles, v.title) END, NOT seen
      FROM f JOIN v ON v.case_id = f.case_id AND v.rank = f.rank + 1, LATERAL (SELECT list_contains(pages, v.page_id) OR list_contains(titles, v.title) AS seen))
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rank) - 1 AS INT) AS place, page_id, title FROM f WHERE kept""")
def two_key_dedupe(spark, sf):
    """Ranked pages per user: a page goes when its id or its title was kept before."""
    rows = d.pick(d.table(spark, sf, "events"), {"case_id": "CAST(user_id AS STRING)", "page_id": "concat('p', CAST(event_id % 9 AS STRING))",
                                                 "title": "concat('t', CAST(event_id % 7 AS STRING))", "event_id": "event_id"})
    from corpusloom.operators.ranking import numbered
    page = evaluation.ranked_page(F.col("page_id"), F.col("title"))
    lists = numbered(rows, ["case_id"], [F.col("event_id")]).groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", page.alias("page")))), lambda x: x["page"]).alias("pages"))
    kept = lists.select("case_id", F.posexplode(evaluation.dedupe_on_two_keys(F.col("pages"))).alias("place", "page"))
    return kept.select("case_id", "place", "page.page_id", "page.title")


@query("e13_rewrite_check", s.build(f"""
SELECT conv_id, turn, CASE WHEN scope_changed THEN {format_sql('m')} ELSE content END = content AS expected_query_match FROM resolved_""", "resolved_"))
def rewrite_check(spark, sf):
    rows = history.carry_anchors(d.korean_turns(spark, sf))
    return rows.select("conv_id", "turn", F.col("resolved.retrieval_query").eqNullSafe(F.col("content")).alias("expected_query_match"))


_norm = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("e14_fact_coverage", f"""
WITH a AS (SELECT conv_id, turn, text, list_concat(regexp_split_to_array(text, '\\s+')[1:2], ['zz missing']) AS facts FROM conversations)
SELECT conv_id, turn, round((len(facts) - len(list_filter(facts, lambda f: NOT contains({_norm.format('text')}, {_norm.format('f')}))))::DOUBLE / len(facts), 6) AS fact_score,
  array_to_string(list_filter(facts, lambda f: NOT contains({_norm.format('text')}, {_norm.format('f')})), '|') AS missing FROM a""")
def fact_coverage(spark, sf):
    rows = d.table(spark, sf, "conversations").withColumn(
        "facts", F.concat(F.slice(F.split("text", r"\s+"), 1, 2), F.array(F.lit("zz missing"))))
    scored = rows.select("conv_id", "turn", *evaluation.fact_score(F.col("text"), F.col("facts")))
    return scored.select("conv_id", "turn", F.round("fact_score", 6).alias("fact_score"), F.array_join("missing_facts", "|").alias("missing"))


@query("e15_source_hits", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END + 1)::DOUBLE / 2 END AS source_score FROM orders""")
def source_hits(spark, sf):
    key = F.col("o_custkey").cast("string")
    sources = F.array(F.struct(F.when(F.col("o_custkey") % 2 == 0, key).alias("page_id"), F.lit("T").alias("title")),
                      F.struct(F.lit(None).cast("string").alias("page_id"), F.col("o_orderpriority").alias("title")))
    relevant = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(key, "o_orderpriority"))
    return d.table(spark, sf, "orders").select("o_orderkey", evaluation.source_score(sources, relevant))


_STATS = """SELECT query_id, budget, count(*) AS prompt_chunk_count, CAST(sum(length(packed)) + 7 * (count(*) - 1) AS BIGINT) AS prompt_context_chars,
  CAST(ceil((sum(length(packed)) + 7 * (count(*) - 1)) / 3.0) AS BIGINT) AS prompt_context_est_tokens, count(DISTINCT page_id) AS prompt_unique_pages FROM packed_"""


@query("e16_prompt_statistics", s.build(_STATS + " WHERE budget = 12000 GROUP BY 1, 2", "packed_"))
def prompt_statistics(spark, sf):
    return evaluation.prompt_statistics(packed(spark, sf, [12000]), ["query_id", "budget"])


@query("e17_budget_sweep", s.build(_STATS + " GROUP BY 1, 2", "packed_"))
def budget_sweep(spark, sf):
    return evaluation.prompt_statistics(packed(spark, sf, fv.CONTEXT_BUDGETS), ["query_id", "budget"])


@query("e17_chunk_sweep", s.build("""
, c AS (SELECT query_id, chunk_count, rank, page_id, page_content FROM qdocs_, (SELECT unnest([5, 10, 20, 40]) AS chunk_count) WHERE rank <= chunk_count),
p AS (SELECT *, substring(page_content, 1, CAST(50000 - used AS INT)) AS packed FROM (
  SELECT *, coalesce(sum(length(page_content)) OVER (PARTITION BY query_id, chunk_count ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
  WHERE used < 50000)
SELECT query_id, chunk_count, count(*) AS prompt_chunk_count, sum(length(packed)) + 7 * (count(*) - 1) AS prompt_context_chars,
       count(DISTINCT page_id) AS prompt_unique_pages FROM p GROUP BY 1, 2""", "qdocs_"))
def chunk_sweep(spark, sf):
    """Prompts of the first 5, 10, 20 and 40 chunks under a budget that they seldom reach."""
    prompts = context.pack_first(ranked_lengths(spark, sf), d.chunks(spark, sf), [5, 10, 20, 40], 50_000)
    return evaluation.prompt_statistics(prompts, ["query_id", "chunk_count"]).drop("prompt_context_est_tokens")


RESULT = {  # BOTH
    "axis_value": "CAST(user_id % 5 AS INT) * 4000", "fact_score": "value / 100", "source_score": "CAST(event_id % 3 AS DOUBLE) / 2",
    "passed": "value > 20", "latency_seconds": "value * 2", "prompt_chunk_count": "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 9 AS INT) END",
    "prompt_context_chars": "user_id * 10", "prompt_context_est_tokens": "user_id * 3", "answer_chars": "event_id % 100", "answer_est_tokens": "event_id % 33",
}
_avgs = ", ".join(f"round(avg(coalesce(CAST({c} AS DOUBLE), 0)), 6) AS {a}" for c, a in evaluation.SWEEP_AVERAGES.items())
s.cte("sweep_", f"SELECT axis_value, count(*) AS case_count, {_avgs} FROM (SELECT {d.both(RESULT)} FROM events) GROUP BY 1")


@query("e18_sweep_summary", s.build("SELECT * FROM sweep_", "sweep_"))
def sweep_summary(spark, sf):
    return _rounded(evaluation.sweep_summary(d.pick(d.table(spark, sf, "events"), RESULT)))


@query("e19_correlation", """
SELECT event_type, count(*) AS pairs, round(corr(value, CAST(user_id AS DOUBLE)), 6) AS r FROM events WHERE value <> 0 OR user_id <> 0 GROUP BY 1""")
def correlation(spark, sf):
    return _rounded(evaluation.pearson(d.table(spark, sf, "events"), "value", "user_id", ["event_type"]))


# --- L: query logs ----------------------------------------------------------------------------------------------

_ROUTES = """coalesce(route, 'unknown') AS route, count(*) AS records, round(avg(coalesce(total_seconds, 0)), 6) AS avg_seconds,
  round(avg(coalesce(prompt_chunks, 0)), 6) AS avg_prompt_chunks FROM log_"""


@query("l1_route_statistics", s.build(f"SELECT {_ROUTES} GROUP BY 1", "log_"))
def route_statistics(spark, sf):
    return _rounded(query_log.route_statistics(d.log_records(spark, sf)))


@query("l2_top_questions", s.build("SELECT question AS value, count(*) AS records FROM log_ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "log_"))
def top_questions(spark, sf):
    return query_log.top_questions(d.log_records(spark, sf).withColumn("question_hash", F.lit(None).cast("string")))


@query("l2_finish_reasons", s.build("SELECT coalesce(finish_reason, 'unknown') AS value, count(*) AS records FROM log_ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "log_"))
def finish_reasons(spark, sf):
    return query_log.finish_reasons(d.log_records(spark, sf))


@query("l3_private_records", s.build("""
SELECT event_id, sha256(question) AS question_hash, CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE 'now' END AS timestamp FROM log_""", "log_"))
def private_records(spark, sf):
    rows = d.log_records(spark, sf).withColumn("timestamp", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))))
    return query_log.shape(rows, F.lit("now"), keep_question=False).select("event_id", "question_hash", "timestamp")


@query("l4_log_records", s.build("""
SELECT event_id, length(question) AS question_chars, prompt_chunks, coalesce(finish_reason, 'end') AS finish_reason, round(total_seconds, 3) AS total_seconds,
       CASE WHEN event_id % 3 > 0 THEN 'long_doc_summary' END AS route, CASE WHEN event_id % 3 > 0 THEN 'why' END AS route_reason, CASE WHEN event_id % 3 > 0 THEN 7 END AS vector_top_k,
       CASE WHEN event_id % 3 > 0 THEN 9000 END AS max_context_chars, CASE WHEN event_id % 3 = 1 THEN 2 WHEN event_id % 3 = 2 THEN 0 END AS mentions,
       CASE WHEN event_id % 3 = 1 THEN 'summary' END AS long_document_mode, CASE WHEN event_id % 3 = 1 THEN 3 END AS selected FROM log_""", "log_"))
def derived_records(spark, sf):
    rows = d.log_records(spark, sf).withColumns({
        "retrieved_docs": F.col("prompt_chunks"), "context_chars": F.lit(0), "generation_seconds": F.col("total_seconds") / 3,
        "retrieval_seconds": F.lit(0.0), "error": F.lit("")})
    found = rows.filter("event_id % 3 > 0").select(F.col("event_id").alias("query_id"), F.lit("long_doc_summary").alias("route"), F.lit("why").alias("route_reason"), *[
        F.lit({"vector_top_k": 7, "max_context_chars": 9000}.get(c, 1)).alias(c) for c in query_log.PROFILE_COLUMNS])
    once = rows.filter("event_id % 3 = 1").select(F.col("event_id").alias("query_id"))
    mentions = once.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("mention_no"), F.lit("jira").alias("source_type"), F.lit("A").alias("space")),
                                                         F.struct(F.lit(2).alias("mention_no"), F.lit("confluence").alias("source_type"), F.lit("B").alias("space")))).alias("m")).select("query_id", "m.*")
    chosen = once.select("query_id", F.lit("summary").alias("long_document_mode"), F.explode(F.array(F.lit(4), F.lit(1), F.lit(2))).alias("chunk_index"))
    records = query_log.with_context(query_log.derive(rows).withColumn("query_id", F.col("event_id")).drop("route", "route_reason"), found, mentions, chosen)
    return records.select("event_id", "question_chars", "prompt_chunks", "finish_reason", "total_seconds", "route", "route_reason", "vector_top_k", "max_context_chars",
                          F.size("mentions").alias("mentions"), "long_document_mode", F.size("selected_chunk_indexes").alias("selected"))


@query("l5_daily_routes", s.build(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_ROUTES} GROUP BY 1, 2", "log_"))
def daily_routes(spark, sf):
    """The events file read as a stream, brought up to date once."""
    folder = work_dir(spark)
    events = spark.readStream.schema(d.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    records = d.pick(events, {**d.LOG, "ts": "ts"}).withColumn("timestamp", F.col("ts").cast("timestamp"))
    log_statistics.run_once(log_statistics.daily_routes(records), folder + "/daily", folder + "/checkpoint")
    rows = spark.read.schema("day string, route string, records long, avg_seconds double, avg_prompt_chunks double").parquet(folder + "/daily")
    return _rounded(rows)
