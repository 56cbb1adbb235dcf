"""The given tables read as domain tables. Expressions in ``BOTH`` strings are plain SQL that both engines run."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.splitter import stride_chunks
from corpusloom.functions.text import general_terms
from corpusloom.storage import stage

NOW_YEAR = 2026
SITE = "https://team.atlassian.net"
BASE = SITE + "/wiki"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key: a file of few bytes a row has too few splits for work that is long per row."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def spread_file(df: DataFrame, key: str) -> DataFrame:
    """A file's rows as they are split, or dealt over all cores by a key where fewer splits than cores hold rows."""
    held = df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df if held >= df.sparkSession.sparkContext.defaultParallelism else spread(df, key)


# --- pages and chunks from documents ------------------------------------------------------------

DOCUMENT = {  # BOTH
    "page_id": "CAST(doc_id AS STRING)",
    "title": "split_part(text, chr(10), 1)",
    "url": "concat('https://kb.example.com/pages/', CAST(doc_id AS STRING))",
    "space": "source",
    "space_name": "concat('Space ', source)",
    "breadcrumb": "concat(lang, ' > ', source, ' > ', split_part(text, chr(10), 1))",
    "source_type": "'confluence'",
    "content_type": "'page'",
    "text": "text",
}


def pick(df: DataFrame, columns: dict) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def both(columns: dict) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def pages(spark, sf):
    return pick(table(spark, sf, "documents"), DOCUMENT)


_STORED = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A derived table that ingest would have written: built once per session, read by every query after that."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        # the given files may hold one row group each; builders spread their source rows, which are smaller than what is made of them
        _STORED[key] = stage(build(spark, sf), name)
    return _STORED[key]


def chunks(spark, sf):
    """The written chunk table."""
    return stored(spark, sf, "chunks", cut_pages)


def cut_pages(spark, sf):
    rows = pick(spread_file(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id"), DOCUMENT)
    cut = rows.select(*[c for c in rows.columns if c != "text"],
                      F.posexplode(stride_chunks(F.col("text"))).alias("chunk_index", "page_content"))
    return cut.withColumn("chunk_id", F.concat_ws(":", "page_id", F.col("chunk_index").cast("string")))


def chunk_embeddings(spark, sf):
    """First chunks of documents carry the vector of the same number."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), "embedding")


def chunks_with_vectors(spark, sf):
    return chunks(spark, sf).join(chunk_embeddings(spark, sf), "chunk_id", "left")


# --- Latin queries from benchmark -----------------------------------------------------------------

def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def searchable(spark, sf):
    """The normalised fields of the chunk table, written as ingest would."""
    from corpusloom.operators.keyword import searchable_chunks
    return stored(spark, sf, "searchable", lambda *a: searchable_chunks(chunks(*a), NOW_YEAR))


def benchmark_terms(spark, sf):
    """Every alphanumeric word of a query; long words of even items are exact terms."""
    words = benchmark_queries(spark, sf).select("query_id", F.explode(general_terms(F.col("query"))).alias("term"))
    exact = (F.length("term") >= 10) & (F.col("query_id").cast("long") % 2 == 0)
    return words.select("query_id", "term", exact.alias("is_exact"), (~exact).alias("is_broad"))


def benchmark_vectors(spark, sf):
    """Query vectors: item n is embedded as vector n."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    return items.join(table(spark, sf, "embeddings"), "vec_id").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("query_id"), "embedding")


# --- Korean questions from orders -------------------------------------------------------------------

PARTS = {  # BOTH
    "YYYY": "CAST(year(o_orderdate) AS STRING)",
    "YY": "lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0')",
    "MM": "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')",
    "M": "CAST(month(o_orderdate) AS STRING)",
    "DD": "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')",
    "D": "CAST(day(o_orderdate) AS STRING)",
    "Q": "CAST(quarter(o_orderdate) AS STRING)",
    "W": "CAST(o_custkey % 5 + 1 AS STRING)",
    "K": "CAST(o_orderkey AS STRING)",
    "N": "CASE o_custkey % 4 WHEN 0 THEN '홍길동' WHEN 1 THEN '이영희' WHEN 2 THEN '김철수' ELSE '박민수' END",
}
QUESTION_TEMPLATES = [
    "{YY}년 {M}월 {D}일자로 기술회의록 알려줘", "{YY}년 {M}월 {W}주차 {N} 주간보고 요약해줘",
    "사내 전결 규정 알려줘 {YYYY}-{MM}-{DD}", "{N} {Q}분기 보고서 요약해줘",
    "{N} {M}월 1주차~{W}주차 주간보고 표로 정리해줘", "@SPACE_{W} {M}월 진행중 이슈 알려줘",
    "SAMPLE 성능지표 문서에서 TPS 값 알려줘 {MM}{DD}", "관련 문서 알려줘",
    "{N}의 {M}월 {W}주차 회의록에서 점검 완료 목록", "AM-{K} 이슈 상태가 완료인지 알려줘 ab-{K} ZZ-{K}는",
    "상반기 프로젝트 현황 알려줘", "하반기 정기점검 예정 jira 이슈", "{N} 것도 보여줘", "다른 사람은?",
    "표로 다시 정리해줘", "{W}주차부터 5주차까지 {N} 주간보고", "{W}-4주차 회의록에서부터 내용을 찾아줘",
    "{YY}-{MM} 유지보수 진행했던 이슈", "문서 전체 요약해줘 {YY}-{MM}-{W}w", "{N}은 {M}월{D}일 회의에서 서버를 점검",
    "문서를 자세히 보여줘", "해야할일 대기 todo 목록 {M}월 {W}주차", "jira project overview {YYYY}.{M}.{D}",
    "이전 내용을 정리해줘",
]


def fill(template: str, parts: dict) -> str:
    """A template as one concat expression."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [f"'{text}'"] * bool(text) + [parts[name]]
    out += [f"'{rest}'"] * bool(rest)
    return f"concat({', '.join(out)})"


def case_of(selector: str, templates: list[str], parts: dict) -> str:
    arms = " ".join(f"WHEN {i} THEN {fill(t, parts)}" for i, t in enumerate(templates))
    return f"CASE {selector} % {len(templates)} {arms} END"


QUESTION = {"query_id": "CAST(o_orderkey AS STRING)", "query": case_of("o_orderkey", QUESTION_TEMPLATES, PARTS)}


def questions(spark, sf):
    return pick(table(spark, sf, "orders"), QUESTION)


# --- Korean conversations ---------------------------------------------------------------------------------

TURN_PARTS = {  # BOTH
    "M": "CAST(conv_id % 12 + 1 AS STRING)",
    "W": "CAST((conv_id + turn) % 5 + 1 AS STRING)",
    "N": "CASE (conv_id + turn) % 3 WHEN 0 THEN '홍길동' WHEN 1 THEN '이영희' ELSE '김철수' END",
}
TURN_TEMPLATES = [
    "{N}의 {M}월 {W}주차 주간보고 요약해줘", "{W}주차도 보여줘", "{N} 것도 보여줘", "표로 정리해줘", "2024년 회의록 알려줘",
    "@TEAM {W}주차 주간보고 알려줘", "점검 목록은?", "{M}월 이슈도 알려줘",
]
KOREAN_TURN = {"conv_id": "conv_id", "turn": "turn", "role": "role",
               "content": case_of("(conv_id * 3 + turn * 5)", TURN_TEMPLATES, TURN_PARTS)}
TURN = {"conv_id": "conv_id", "turn": "turn", "role": "role", "content": "text"}


def korean_turns(spark, sf):
    return pick(table(spark, sf, "conversations"), KOREAN_TURN)


def turns(spark, sf):
    return pick(table(spark, sf, "conversations"), TURN)


# --- issues from orders and customers -------------------------------------------------------------------------

ISSUE = {  # BOTH
    "key": "concat(c_mktsegment, '-', CAST(o_orderkey AS STRING))",
    "project": "c_mktsegment",
    "project_name": "concat(c_mktsegment, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' Maintenance' ELSE ' Project' END)",
    "summary": "concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3, 5), "
               "CASE WHEN o_custkey % 3 = 0 THEN ' 정기점검 ' ELSE ' 작업 ' END, c_name)",
    "status_key": "CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'done' ELSE '' END",
    "status_name": "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE 'In Progress' END",
    "assignee": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE c_name END",
    "reporter": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'desk' END",
    "created": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "updated": "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) AS STRING)",
    "duedate": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS STRING) END",
    "priority": "o_orderpriority",
}
# id, name, text of two custom fields
FIELDS = [
    ("customfield_10001", "CASE WHEN o_orderkey % 2 = 0 THEN '점검일' ELSE '담당팀' END",
     "CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 7 AS STRING) ELSE concat('team ', o_orderpriority) END"),
    ("customfield_10002", "'Target Date'", "concat(CAST(month(o_orderdate) AS STRING), '월 ', CAST(day(o_orderdate) AS STRING), '일')"),
]


def issues(spark, sf, dealt=False):
    """Issues; ``dealt`` over all cores for long work per issue."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").join(
        table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = spread(rows, "o_orderkey") if dealt else rows
    fields = ", ".join(f"named_struct('id', '{i}', 'name', {n}, 'text', {t})" for i, n, t in FIELDS)
    return pick(rows, {**ISSUE, "fields": f"array({fields})"})


# --- notes of a customer's orders, one paragraph each -----------------------------------------------------------

# lengths from 20 to 719 characters, so pieces end after one to many notes
NOTE = "rpad(concat('order ', CAST(o_orderkey AS STRING), ' '), CAST(20 + o_orderkey * 7 % 700 AS INT), 'x')"  # BOTH


def order_notes(spark, sf):
    """(page, notes): the notes of a customer in the order of their numbers."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr(NOTE).alias("note"))
    notes = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "note"))), lambda n: n["note"])
    return rows.groupBy(F.col("o_custkey").alias("page")).agg(notes.alias("notes"))


# --- dated Korean pages from orders ---------------------------------------------------------------------------------

DATED_PAGE = {  # BOTH
    "chunk_id": "CAST(o_orderkey AS STRING)",
    "page_id": "CAST(o_custkey AS STRING)",
    "title": f"CASE o_orderkey % 3 WHEN 0 THEN {fill('{YY}{MM}{DD} 주간회의', PARTS)} WHEN 1 THEN {fill('{YY}-{MM} 정기점검 보고', PARTS)} "
             f"ELSE {fill('{M}월 전사 규정', PARTS)} END",
    "url": "concat('u', CAST(o_custkey AS STRING))",
    "breadcrumb": "CASE WHEN o_orderkey % 2 = 0 THEN '연구소 > 기술회의' ELSE '전사 > 공지사항' END",
    "space": "CASE WHEN o_custkey % 2 = 0 THEN 'TEAM' ELSE 'LAB' END",
    "space_name": "CASE WHEN o_custkey % 2 = 0 THEN 'Team Space' ELSE 'Lab Space' END",
    "source_type": "'confluence'",
    "content_type": "'page'",
    "chunk_index": "CAST(o_orderkey % 7 AS INT)",
    "page_content": fill("{N} {M}월 {W}주차 회의록 {K} 점검 완료", PARTS),
}


def dated_pages(spark, sf):
    return stored(spark, sf, "dated_pages", _dated_pages)


def _dated_pages(spark, sf):
    return pick(spread_file(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey"), DATED_PAGE)


# one question per month that occurs in the orders
MONTH_QUESTION = {  # BOTH
    "query_id": fill("{YYYY}-{MM}", PARTS),
    "query": f"CASE (year(o_orderdate) + month(o_orderdate)) % 3 WHEN 0 THEN {fill('{M}월 회의록 점검 알려줘', PARTS)} "
             f"WHEN 1 THEN {fill('{M}월 규정 알려줘 {YY}-{MM}', PARTS)} ELSE {fill('{YY}년 {M}월 1주차 기술회의 정리해줘', PARTS)} END",
}


def month_questions(spark, sf):
    """The batch of questions as a table of its own; its rules must not be pushed down to the orders behind it."""
    return stored(spark, sf, "month_questions", lambda *a: pick(table(*a, "orders"), MONTH_QUESTION).distinct())


# --- query log from events -----------------------------------------------------------------------------------------------

LOG = {  # BOTH
    "event_id": "event_id",
    "question": "concat('question ', CAST(user_id AS STRING))",
    "route": "CASE event_type WHEN 'view' THEN 'exact_lookup' WHEN 'click' THEN 'fallback' WHEN 'purchase' THEN 'multi_doc_summary' "
             "WHEN 'signup' THEN 'long_doc_lookup' END",
    "finish_reason": "CASE WHEN user_id % 9 = 0 THEN 'length' WHEN user_id % 11 = 0 THEN NULL ELSE 'end' END",
    "total_seconds": "CASE WHEN user_id % 13 = 0 THEN NULL ELSE value END",
    "prompt_chunks": "CASE WHEN user_id % 17 = 0 THEN NULL ELSE CAST(user_id % 12 AS INT) END",
}


def log_records(spark, sf):
    return pick(table(spark, sf, "events"), {**LOG, "ts": "ts"})


# --- ranked lists and rankings from events ---------------------------------------------------------------------------------

RANKED = {  # BOTH
    "query_id": "CAST(user_id AS STRING)",
    "list": "CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'keyword' ELSE 'status' END",
    "chunk_id": "concat('c', CAST(event_id % 23 AS STRING))",
    "title": "CASE event_id % 23 % 4 WHEN 0 THEN 'Alpha notes' WHEN 1 THEN 'Beta, alpha plan' WHEN 2 THEN 'gamma' ELSE 'none' END",
    "bm25_score": "CASE WHEN event_type = 'click' THEN value END",
    "title_match_score": "CASE WHEN event_type = 'click' THEN CAST(event_id % 3 AS DOUBLE) / 2 END",
    "event_id": "event_id",
}
# status hits only exist for two thirds of the users
RANKED_FROM = "event_type IN ('view', 'click') OR (event_type = 'purchase' AND user_id % 3 > 0)"  # BOTH
RANKED_QUERY = {  # BOTH
    "query_id": "CAST(user_id AS STRING)",
    "query": "CASE WHEN user_id % 2 = 0 THEN '완료 이슈 alpha gamma' ELSE 'alpha beta delta' END",
}


def ranked_lists(spark, sf):
    from corpusloom.operators.ranking import numbered
    rows = pick(table(spark, sf, "events").filter(RANKED_FROM), RANKED)
    return numbered(rows, ["query_id", "list"], [F.col("event_id")])


def ranked_queries(spark, sf):
    return pick(table(spark, sf, "events"), RANKED_QUERY).distinct()


def ranked_terms(spark, sf):
    words = F.regexp_extract_all("query", F.lit("([a-z]+)"), F.lit(1))
    return ranked_queries(spark, sf).select("query_id", F.explode(words).alias("term"))


# --- issue questions: one per project, month and status that occurs --------------------------------------------------------------

ISSUE_QUESTION = {  # BOTH
    "query_id": "concat(c_mktsegment, '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', o_orderstatus)",
    "space": "c_mktsegment",
    "query": "concat(CASE WHEN month(o_orderdate) % 2 = 0 THEN concat(c_mktsegment, ' 프로젝트 ') ELSE '' END, "
             "CASE WHEN month(o_orderdate) % 3 > 0 THEN concat(CAST(month(o_orderdate) AS STRING), '월 ') ELSE '' END, "
             "CASE o_orderstatus WHEN 'O' THEN '해야할 점검 이슈' WHEN 'F' THEN '완료 이슈' ELSE '진행했던 유지보수 점검' END)",
}


def issue_questions(spark, sf):
    return stored(spark, sf, "issue_questions", _issue_questions)


def _issue_questions(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return pick(rows, ISSUE_QUESTION).distinct()
