"""Scans, writes, page preparation, issues and the source catalogue."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import html, richdoc, splitter, status, text
from corpusloom.operators import catalogue, issues, prepare
from corpusloom.operators.vector import dimension_guard
from corpusloom.plans import ingest
from corpusloom.sources import landed, log_sink, snapshot
from corpusloom.storage import stage, work_dir
from suite import domain as d
from suite import sql as s
from suite.registry import query

# --- S: scans and writes -------------------------------------------------------------------------------


@query("s1_chunk_scan", s.build(
    "SELECT chunk_id, page_id, space, chunk_index, md5(page_content) AS content FROM chunks_ WHERE length(page_content) > 0", "chunks_"))
def chunk_scan(spark, sf):
    rows = landed.equality_scan(d.chunks(spark, sf)).filter(F.length("page_content") > 0)
    return rows.select("chunk_id", "page_id", "space", "chunk_index", F.md5("page_content").alias("content"))


@query("s2_filtered_scan", """
SELECT doc_id, source, lang FROM documents
WHERE lang = 'en' AND (source = 'src1' OR n_chars = 500) AND source IS DISTINCT FROM 'src2'""")
def filtered_scan(spark, sf):
    rows = landed.equality_scan(d.table(spark, sf, "documents"), {"lang": "en"}, {"source": "src1", "n_chars": 500}, {"source": "src2"})
    return rows.select("doc_id", "source", "lang")


@query("s7_log_append", s.build("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS log_date, count(*) AS records, count(DISTINCT question) AS questions FROM log_ GROUP BY 1""", "log_"))
def log_append(spark, sf):
    folder = work_dir(spark) + "/query-log"
    rows = d.log_records(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).drop("ts")
    for _ in range(2):  # the second attempt at the same batch adds nothing
        log_sink.append(rows, folder, batch="0")
    written = log_sink.read_log(spark, folder, "question string")
    return written.groupBy("log_date").agg(F.count("*").alias("records"), F.count_distinct("question").alias("questions"))


@query("s8_retention", """
SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY""")
def retention(spark, sf):
    rows = d.table(spark, sf, "events").withColumnRenamed("ts", "timestamp")
    now = rows.agg(F.max("timestamp")).scalar()
    return log_sink.within_retention(rows, now, 5).select("event_id")


RUNS = {  # BOTH
    "event_id": "event_id", "source_type": "CASE WHEN user_id % 2 = 0 THEN 'confluence' ELSE 'jira' END",
    "space": "event_type", "ingest_run_id": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('run', CAST(user_id % 5 AS STRING)) END",
}


def runs(spark, sf):
    return d.pick(d.table(spark, sf, "events"), RUNS)


@query("s9_replace_source", s.build("""
SELECT source_type, space, ingest_run_id, count(*) AS chunks FROM (
  SELECT source_type, CASE WHEN chunk_index = 0 THEN space ELSE 'rest' END AS space,
         CASE WHEN chunk_index = 0 THEN 'run2' ELSE 'run1' END AS ingest_run_id FROM chunks_) GROUP BY ALL""", "chunks_"))
def replace_source(spark, sf):
    table = work_dir(spark) + "/chunks"
    rows = d.chunks(spark, sf).select("chunk_id", "page_id", "source_type", "space", "chunk_index", "page_content")
    # first run: all chunks, the later ones under one space of their own; second run replaces the page heads only
    first = rows.withColumn("space", F.when(F.col("chunk_index") == 0, F.col("space")).otherwise("rest"))
    snapshot.replace_source(first, table, "run1")
    snapshot.replace_source(rows.filter("chunk_index = 0"), table, "run2")
    return snapshot.read_table(spark, table).groupBy("source_type", "space", "ingest_run_id").agg(F.count("*").alias("chunks"))


@query("s9_latest_snapshot", f"""
WITH r AS (SELECT {d.both(RUNS)}, ts FROM events),
c AS (SELECT source_type, space, arg_max(ingest_run_id, ts) AS ingest_run_id FROM r WHERE ingest_run_id IS NOT NULL GROUP BY 1, 2)
SELECT event_id, source_type, space, ingest_run_id FROM r JOIN c USING (source_type, space, ingest_run_id)""")
def latest_snapshot(spark, sf):
    rows = d.pick(d.table(spark, sf, "events"), {**RUNS, "ts": "ts"})
    committed = rows.filter("ingest_run_id IS NOT NULL").select("source_type", "space", "ingest_run_id", F.col("ts").alias("committed_at"))
    return snapshot.latest_snapshot(rows, committed).select("event_id", "source_type", "space", "ingest_run_id")


@query("s10_failed_runs", f"""
SELECT event_id FROM (SELECT {d.both(RUNS)} FROM events) WHERE ingest_run_id IS DISTINCT FROM 'run3'""")
def failed_runs(spark, sf):
    rows = runs(spark, sf)
    failed = rows.filter("ingest_run_id = 'run3'").select("ingest_run_id").distinct()
    return snapshot.without_failed_runs(rows, failed).select("event_id")


@query("s11_delete_stale", f"""
SELECT event_id, 'keep' AS mode FROM (SELECT {d.both(RUNS)} FROM events)
WHERE NOT (source_type = 'jira' AND space = 'click' AND ingest_run_id IS DISTINCT FROM 'run1')
UNION ALL SELECT event_id, 'only' FROM (SELECT {d.both(RUNS)} FROM events)
WHERE NOT (source_type = 'jira' AND space = 'click' AND ingest_run_id IS NOT DISTINCT FROM 'run1')""")
def delete_stale(spark, sf):
    rows = runs(spark, sf)
    kept = snapshot.delete_rows(rows, "jira", "click", keep_run="run1").select("event_id", F.lit("keep").alias("mode"))
    return kept.unionByName(snapshot.delete_rows(rows, "jira", "click", only_run="run1").select("event_id", F.lit("only").alias("mode")))


@query("s12_dimension_guard", "SELECT len(embedding) AS dimension, count(*) AS vectors FROM embeddings GROUP BY 1")
def guard(spark, sf):
    return dimension_guard(d.table(spark, sf, "embeddings"), 64)


# --- S3-S6 land table rows as JSON lines and read them back with the explicit schemas -----------------------

def _land(df, name):
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.json(path)
    return path


def _issue_json(spark, sf, project=None):
    rows = d.issues(spark, sf)
    status_ = F.struct(F.col("status_name").alias("name"), F.struct(F.col("status_key").alias("key")).alias("statusCategory"))
    fields = F.struct(
        "summary", F.struct(F.col("project_name").alias("name")).alias("project"), status_.alias("status"),
        F.struct(F.col("assignee").alias("displayName")).alias("assignee"), F.struct(F.col("reporter").alias("displayName")).alias("reporter"),
        F.struct(F.col("priority").alias("name")).alias("priority"), "created", "updated", "duedate",
        F.get("fields", F.lit(0))["text"].alias("customfield_10001"), F.get("fields", F.lit(1))["text"].alias("customfield_10002"))
    return rows.select("key", fields.alias("fields"), "project")


@query("s3_landed_issues", s.build("""
SELECT key, project_name, status_name, status_key, assignee, updated, duedate, priority FROM issues_""", "issues_"))
def landed_issues(spark, sf):
    """Every project's own landed file, read as one."""
    path = work_dir(spark) + "/issues"
    _issue_json(spark, sf).write.partitionBy("project").json(path)
    projects = [r.project for r in d.issues(spark, sf).select("project").distinct().collect()]  # the five segments
    rows = reduce(DataFrame.unionByName, [landed.issues(spark, f"{path}/project={p}", p) for p in sorted(projects)])
    return rows.select("key", "project_name", "status_name", "status_key", "assignee", "updated", "duedate", "priority")


@query("s4_landed_pages", """
SELECT CAST(page_id AS VARCHAR) AS id, 'P' || page_id AS title, md5(html) AS body FROM pages""")
def landed_pages(spark, sf):
    even = F.col("page_id") % 2 == 0
    raw = d.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), F.lit("page").alias("type"),
        F.struct(F.struct(F.when(even, F.col("html")).otherwise("").alias("value")).alias("export_view"),
                 F.struct(F.when(~even, F.col("html")).otherwise("unused").alias("value")).alias("storage")).alias("body"))
    rows = landed.pages(spark, _land(raw, "pages"))
    return rows.select("id", "title", F.md5(prepare.page_body(F.col("export_view"), F.col("storage"))).alias("body"))


@query("s5_golden_cases", """
SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS query, item_id % 3 AS grades, 0 AS facts, 0 AS turns FROM benchmark""")
def golden_cases(spark, sf):
    raw = d.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("p1"))).alias("relevant_pages"),
        F.when(F.col("item_id") % 3 > 0, F.create_map(F.lit("p1"), (F.col("item_id") % 3).cast("int"))).alias("relevance_grades"))
    cases = landed.golden_cases(spark, _land(raw, "cases"))
    return cases.select("id", F.md5("query").alias("query"), F.coalesce(F.map_values("relevance_grades")[0], F.lit(0)).alias("grades"),
                        F.size("expected_facts").alias("facts"), F.size("history").alias("turns"))


@query("s6_query_log", s.build("""
SELECT coalesce(route, 'none') AS route, count(*) AS records, sum(prompt_chunks) AS prompt_chunks FROM log_ GROUP BY 1""", "log_"))
def query_log(spark, sf):
    folder = f"{work_dir(spark)}/log"
    rows = d.log_records(spark, sf).drop("ts", "event_id")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(folder + "/day")
    raw = spark.read.text(folder + "/day")
    return landed.log_rows(raw).groupBy(F.coalesce("route", F.lit("none")).alias("route")).agg(
        F.count("*").alias("records"), F.sum("prompt_chunks").alias("prompt_chunks"))


# --- I: pages -------------------------------------------------------------------------------------------------

_hidden = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
_tags = r"(?s)<!--.*?-->|<[!/a-zA-Z][^>]*>"


def _visible_sql(c):
    plain = f"regexp_replace(regexp_replace({c}, '{_hidden}', chr(10), 'g'), '{_tags}', chr(10), 'g')"
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]:
        plain = f"replace({plain}, '{name}', '{char}')"
    runs_ = f"list_transform(string_split({plain}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_filter({runs_}, lambda x: x <> ''), chr(10))"


@query("i6_visible_text", f"SELECT page_id, md5({_visible_sql('html')}) AS visible, length({_visible_sql('html')}) AS chars FROM pages")
def visible_text(spark, sf):
    shown = html.visible_text(F.col("html"))
    return d.table(spark, sf, "pages").select("page_id", F.md5(shown).alias("visible"), F.length(shown).alias("chars"))


def _web_pages(spark, sf):
    page_id = F.col("page_id").cast("string")
    return d.table(spark, sf, "pages").select(
        page_id.alias("id"), F.concat(F.lit("Page "), page_id).alias("title"), F.lit("page").alias("kind"), "url", F.col("html").alias("body"),
        F.lit(None).cast("string").alias("adf"), F.lit("WEB").alias("space"), F.lit("Web").alias("space_name"),
        F.concat(F.lit("Web > Page "), page_id).alias("breadcrumb"))


@query("i6_page_text")
def page_text(spark, sf):
    rows = prepare.page_text(_web_pages(spark, sf))
    return rows.select("id", F.md5("text").alias("text"), F.length("text").alias("chars"))


# links to issues and projects, and a table per order, written as mark-up
LINK_PAGE = {  # BOTH
    "id": "CAST(o_orderkey AS STRING)",
    "body": "concat('<p>See <a class=\"jira-issue\" data-issue-key=\"', c_mktsegment, '-', CAST(o_orderkey AS STRING), '\">', "
            "CASE WHEN o_orderkey % 2 = 0 THEN concat(c_mktsegment, '-', CAST(o_orderkey AS STRING)) ELSE 'the order' END, "
            "'</a> of <a href=\"https://x/jira/projects/', c_mktsegment, '/board\">https://x</a>.</p>')",
}


def _linked_orders(spark, sf):
    rows = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        d.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return d.spread(rows.select("o_orderkey", "c_mktsegment"), "o_orderkey")


@query("i5_link_labels", s.build("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, '# T' || chr(10) || chr(10) || chr(10) || chr(10) || 'See  [Related Jira issue: ' || CASE WHEN o_orderkey % 2 = 0 THEN
  c_mktsegment || '-' || o_orderkey || ': ' || i.summary || ' (' || i.status_name || ')' ELSE 'the order' END ||
  ']  of  [Related Jira project: ' || i.project_name || ' (' || c_mktsegment || ')] .' AS text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN issues_ i ON i.key = c_mktsegment || '-' || o_orderkey""", "issues_"))
def link_labels(spark, sf):
    known = d.issues(spark, sf)
    pages = d.pick(_linked_orders(spark, sf), LINK_PAGE).withColumn("title", F.lit("T")).withColumn("adf", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    dims = known.select("key", "summary", F.col("status_name").alias("status"), none.alias("custom"))
    projects = known.select(F.col("project").alias("key"), F.col("project_name").alias("name")).distinct()
    return prepare.page_text(pages, prepare.link_labels(pages, dims, projects)).select("id", "text")


@query("i9_rich_rewrite", s.build("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, '# T' || chr(10) || chr(10) || chr(10) || chr(10) || 'See  [Related Jira issue: ' || CASE WHEN o_orderkey % 2 = 0 THEN
  c_mktsegment || '-' || o_orderkey || ': ' || i.summary || ' (' || i.status_name || ')' ELSE 'the order' END ||
  ']  of  [Related Jira project: ' || i.project_name || ' (' || c_mktsegment || ')] .' || chr(10) || chr(10) || concat_ws(chr(10), '[Table start]', 'Rows: 1',
  'Columns: no, flag', '', '| no | flag |', '| --- | --- |', '| 1 | a\\|b ' || o_orderkey || ' |', '[Table end]') AS text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN issues_ i ON i.key = c_mktsegment || '-' || o_orderkey""", "issues_"))
def rich_rewrite(spark, sf):
    """Macros, links and tables of one page together; the embedded issue table goes."""
    known = d.issues(spark, sf)
    rows = _linked_orders(spark, sf)
    tables = F.concat(F.lit("<table><tr><th>no</th><th>flag</th></tr><tr><td>1</td><td>a|b "), F.col("o_orderkey").cast("string"),
                      F.lit("</td></tr></table><table><tr><th>Key</th><th>Summary</th><th>Status</th></tr><tr><td>"), F.col("c_mktsegment"),
                      F.lit("-1</td><td>s</td><td>Open</td></tr></table>"))
    pages = rows.selectExpr(*[f"{e} AS {n}" for n, e in LINK_PAGE.items()], "o_orderkey", "c_mktsegment").withColumn("body", F.concat("body", tables))
    pages = pages.select("id", "body", F.lit("T").alias("title"), F.lit(None).cast("string").alias("adf"))
    none = F.array().cast("array<string>")
    dims = known.select("key", "summary", F.col("status_name").alias("status"), none.alias("custom"))
    projects = known.select(F.col("project").alias("key"), F.col("project_name").alias("name")).distinct()
    return prepare.page_text(pages, prepare.link_labels(pages, dims, projects)).select("id", "text")


def _order_cells(spark, sf):
    line = F.array(F.col("l_linenumber").cast("string"), "l_returnflag", F.concat(F.lit("p|"), F.col("l_partkey").cast("string")))
    return d.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", line.alias("c")))), lambda x: x["c"]).alias("cells"))


_GRID = """
, r AS (SELECT l_orderkey, string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' | p\\|' || l_partkey || ' |', chr(10)
               ORDER BY l_linenumber, l_partkey, l_returnflag) AS body, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, concat_ws(chr(10), '[Table start]', 'Rows: ' || n, 'Columns: no, flag, part', '', '| no | flag | part |', '| --- | --- | --- |',
       body, '[Table end]') AS text FROM r"""


@query("i7_table_text", "WITH one AS (SELECT 1)" + _GRID)
def table_text(spark, sf):
    td = lambda c: F.concat(F.lit("<td> "), c, F.lit("\n</td>"))
    row = F.transform("cells", lambda r: F.concat(F.lit("<tr>"), td(r[0]), td(r[1]), td(r[2]), F.lit("</tr>")))
    head = F.lit("<table><tr><th>no</th><th>flag</th><th>part</th></tr>")
    pages = _order_cells(spark, sf).select("l_orderkey", F.concat(head, F.array_join(row, ""), F.lit("</table>")).alias("body"))
    tables = pages.select("l_orderkey", F.explode(html.html_tables("body")).alias("t"))
    return tables.select("l_orderkey", html.render_grid(F.col("t.cells"), F.col("t.has_header")).alias("text"))


@query("i8_issue_tables", """
SELECT l_orderkey, count(*) AS blocks FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 3 > 0) GROUP BY 1""")
def issue_tables(spark, sf):
    """Every third order's table has the issue header and keys, so it is dropped from the text."""
    is_issue = F.col("l_orderkey") % 3 == 0
    head = F.when(is_issue, "<tr><th>Key</th><th>Summary</th><th>Status</th></tr>").otherwise("<tr><th>no</th><th>flag</th><th>part</th></tr>")
    row = F.transform("cells", lambda r: F.concat(F.lit("<tr><td>AB-"), r[0], F.lit("</td><td>"), r[1], F.lit("</td><td>"), r[2], F.lit("</td></tr>")))
    pages = _order_cells(spark, sf).select("l_orderkey", F.concat(F.lit("<table>"), head, F.array_join(row, ""), F.lit("</table>")).alias("body"))
    return pages.select("l_orderkey", F.explode(html.html_table_blocks("body"))).groupBy("l_orderkey").agg(F.count("*").alias("blocks"))


@query("i10_table_split", """
SELECT l_orderkey, count(*) AS pieces, true AS whole FROM (SELECT l_orderkey FROM lineitem GROUP BY 1), range(3) GROUP BY 1""")
def table_split(spark, sf):
    grid = html.render_grid(F.col("cells"), F.lit(False))
    text_ = F.concat(F.lit("before\n\n"), grid, F.lit("\n\nafter"))
    rows = _order_cells(spark, sf).select("l_orderkey", grid.alias("grid"), splitter.table_aware_chunks(text_).alias("pieces"))
    return rows.select("l_orderkey", F.size("pieces").alias("pieces"), (F.get("pieces", F.lit(1)) == F.col("grid")).alias("whole"))


def _supplier_cells(spark, sf):
    line = F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag")
    rows = d.table(spark, sf, "lineitem")
    # a page per supplier and hundred parts keeps the table of one page bounded
    page = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.floor(F.col("l_partkey") / 100).cast("string"))
    return rows.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(line)).alias("cells"))


@query("i11_oversized_tables", """
SELECT l_suppkey || '/' || (l_partkey // 100) AS page, count(*) AS data_rows, true AS bounded FROM lineitem GROUP BY 1""")
def oversized_tables(spark, sf):
    pieces = F.explode(splitter.table_aware_chunks(html.render_grid(F.col("cells"), F.lit(False))))
    rows = _supplier_cells(spark, sf).select("page", pieces.alias("piece"))
    lines = F.filter(F.split("piece", "\n"), lambda x: F.startswith(x, F.lit("| ")) & ~F.startswith(x, F.lit("| ---")))
    return rows.groupBy("page").agg(
        F.sum(F.size(lines) - 1).alias("data_rows"), F.max(F.length("piece") <= 6000).alias("bounded"))


@query("i10_split_pieces", """
WITH g AS (SELECT l_orderkey, count(*) AS n, string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' | p|' || l_partkey || ' |', chr(10)
           ORDER BY l_linenumber, l_partkey, l_returnflag) AS body FROM lineitem GROUP BY 1)
SELECT l_orderkey, piece_no, CASE piece_no WHEN 1 THEN 'before' WHEN 3 THEN 'after' ELSE concat_ws(chr(10), '[Table start]', 'Rows: ' || n,
  'Columns: Column 1, Column 2, Column 3', '', '| Column 1 | Column 2 | Column 3 |', '| --- | --- | --- |', body, '[Table end]') END AS text
FROM g, (SELECT unnest([1, 2, 3]) AS piece_no)""")
def split_pieces(spark, sf):
    """The pieces themselves: text before a table, the table untouched, text after it."""
    text_ = F.concat(F.lit("before\n\n"), html.render_grid(F.col("cells"), F.lit(False)), F.lit("\n\nafter"))
    rows = _order_cells(spark, sf).select("l_orderkey", F.posexplode(splitter.table_aware_chunks(text_)).alias("n", "text"))
    return rows.select("l_orderkey", (F.col("n") + 1).alias("piece_no"), "text")


@query("i11_table_pieces", """
WITH RECURSIVE r AS (
  SELECT l_suppkey || '/' || (l_partkey // 100) AS page, [CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag] AS cells
  FROM lineitem),
o AS (SELECT page, '| ' || array_to_string(cells, ' | ') || ' |' AS line, count(*) OVER (PARTITION BY page) AS n,
        row_number() OVER (PARTITION BY page ORDER BY cells[1], cells[2], cells[3], cells[4]) AS i FROM r),
h AS (SELECT *, concat_ws(chr(10), '[Table start]', 'Rows: ' || n, 'Columns: Column 1, Column 2, Column 3, Column 4', '',
        '| Column 1 | Column 2 | Column 3 | Column 4 |', '| --- | --- | --- | --- |', '') AS head,
        CAST(sum(length(line) + 1) OVER (PARTITION BY page ORDER BY i) AS BIGINT) AS upto FROM o),
x AS (SELECT *, max(i) OVER (PARTITION BY page ORDER BY upto RANGE BETWEEN CURRENT ROW AND (6000 - length(head) - 11 - length(line) - 1) FOLLOWING) AS last_row FROM h),
p AS (SELECT page, 1 AS piece_no, i, last_row FROM x WHERE i = 1
      UNION ALL SELECT x.page, p.piece_no + 1, x.i, x.last_row FROM p JOIN x ON x.page = p.page AND x.i = p.last_row + 1)
SELECT p.page, p.piece_no, count(*) AS data_rows, md5(any_value(head) || string_agg(line || chr(10), '' ORDER BY x.i) || '[Table end]') AS text
FROM p JOIN x ON x.page = p.page AND x.i BETWEEN p.i AND p.last_row GROUP BY 1, 2""")
def table_pieces(spark, sf):
    """Every piece of an oversized table by content: repeated header, its own rows, end mark."""
    pieces = F.posexplode(splitter.table_aware_chunks(html.render_grid(F.col("cells"), F.lit(False)))).alias("n", "piece")
    lines = F.filter(F.split("piece", "\n"), lambda x: F.startswith(x, F.lit("| ")) & ~F.startswith(x, F.lit("| ---")))
    return _supplier_cells(spark, sf).select("page", pieces).select(
        "page", (F.col("n") + 1).alias("piece_no"), (F.size(lines) - 1).alias("data_rows"), F.md5("piece").alias("text"))


@query("i13_table_repair", "WITH one AS (SELECT 1)" + _GRID.replace("AS text FROM r", "AS block FROM r").replace(
    "SELECT l_orderkey, concat_ws", ", g AS (SELECT l_orderkey, concat_ws") + """)
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'Intro ' || block ELSE 'Intro' || chr(10) || chr(10) || block END AS text FROM g""")
def table_repair(spark, sf):
    cells = F.transform("cells", lambda r: F.array(r[0], r[1], F.replace(r[2], F.lit("|"), F.lit("\\|"))))
    head = F.array(F.array(F.lit("no"), F.lit("flag"), F.lit("part")))
    rows = _order_cells(spark, sf).select("l_orderkey", html.render_grid(F.concat(head, cells), F.lit(True)).alias("block"))
    kept = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("Intro "), "block")).otherwise("Intro  \n")
    return rows.select("l_orderkey", splitter.append_missing_blocks(kept, F.array("block")).alias("text"))


RICH = {  # BOTH
    "id": "CAST(o_orderkey AS STRING)",
    "adf": "concat('{\"type\":\"doc\",\"content\":[{\"type\":\"heading\",\"attrs\":{\"level\":2},\"content\":[{\"type\":\"text\",\"text\":\"', o_orderpriority, "
           "'\"}]},{\"type\":\"bulletList\",\"content\":[{\"type\":\"listItem\",\"content\":[{\"type\":\"paragraph\",\"content\":[{\"type\":\"text\",\"text\":\"k', "
           "CAST(o_orderkey AS STRING), '\"}]}]}]}]}')",
}


@query("i14_rich_markdown", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, '## ' || o_orderpriority || chr(10) || chr(10) || '- k' || o_orderkey || chr(10) || chr(10) AS text FROM orders""")
def rich_markdown(spark, sf):
    return d.pick(d.table(spark, sf, "orders"), RICH).select("id", richdoc.rich_markdown("adf").alias("text"))


@query("i15_rich_plain", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || ' - k' || o_orderkey AS text FROM orders")
def rich_plain(spark, sf):
    return d.pick(d.table(spark, sf, "orders"), RICH).select("id", richdoc.rich_plain("adf").alias("text"))


def _nation_path(spark, sf):
    nation, region = d.table(spark, sf, "nation"), d.table(spark, sf, "region")
    path = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return path.select("n_nationkey", F.array(F.struct(F.col("r_name").alias("title")), F.struct(F.col("n_name").alias("title"))).alias("ancestors"))


@query("i16_breadcrumb", """
SELECT c_custkey, r_name || ' > ' || n_name || ' > ' || c_name AS breadcrumb
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def breadcrumbs(spark, sf):
    rows = d.table(spark, sf, "customer").join(_nation_path(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", prepare.breadcrumb(F.col("ancestors"), F.col("c_name")).alias("breadcrumb"))


@query("i17_page_chunks", s.build("""
, n AS (SELECT page_id, count(*) AS n FROM chunks_ GROUP BY 1)
SELECT c.chunk_id, c.chunk_index, md5('Content type: page' || chr(10) || 'Space: ' || space_name || ' (' || space || ')' || chr(10) || 'Document location: ' ||
  breadcrumb || chr(10) || chr(10) || 'Chunk: ' || (c.chunk_index + 1) || '/' || n || chr(10) || chr(10) || 'Content:' || chr(10) || page_content) AS content
FROM chunks_ c JOIN n USING (page_id) WHERE length(page_content) > 0""", "chunks_"))
def page_chunks(spark, sf):
    rows = d.pages(spark, sf).withColumnsRenamed({"page_id": "id", "content_type": "kind"})
    return prepare.page_chunks(rows, splitter.stride_chunks(F.col("text"))).select("chunk_id", "chunk_index", F.md5("page_content").alias("content"))


@query("i18_object_chunks", """
SELECT CAST(c_custkey AS VARCHAR) AS page_id, 0 AS chunk_index, 'Chunk: 1/1' || chr(10) || chr(10) || 'Content:' || chr(10) || 'Content type: database' || chr(10) || 'Title: ' || c_name || chr(10) ||
 'Database ID: ' || c_custkey || chr(10) || 'Space: Sales (S)' || chr(10) || 'Document location: ' || n_name || ' > ' || c_name || chr(10) ||
 'Parent: content ' || c_nationkey || chr(10) || 'Version: 3' || chr(10) || 'Direct children:' || chr(10) || '- page: ' || c_mktsegment || chr(10) ||
 'Note: Confluence''s public REST API exposes database metadata, but not database rows/entries for indexing.' AS page_content
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def object_chunks(spark, sf):
    rows = d.table(spark, sf, "customer").join(d.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    objects = rows.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").cast("string").alias("parentId"),
        F.lit("").alias("parentType"), F.lit("S").alias("spaceKey"),
        F.struct(F.lit(3).alias("number"), F.lit(None).cast("string").alias("createdAt")).alias("version"),
        F.array(F.struct(F.lit("x").alias("id"), F.col("c_mktsegment").alias("title"), F.lit("page").alias("type"))).alias("directChildren"),
        F.array(F.struct(F.col("n_name").alias("title")), F.struct(F.lit("").alias("title"))).alias("ancestors"))
    return prepare.object_chunks(objects, "S", "Sales", d.SITE, d.BASE).select("page_id", "chunk_index", "page_content")


@query("i19_images", """
SELECT CAST(p_partkey AS VARCHAR) AS page_id, 'f ' || p_size || '.png' AS title, 'https://team.atlassian.net/wiki/a/f%20' || p_size || '.png' AS image_url,
 0 AS chunk_index, 'Content type: image' || chr(10) || 'Parent page: ' || p_name || chr(10) || 'Space: Parts (P)' || chr(10) || 'Document location: P > ' || p_name || chr(10) ||
 'Filename: f ' || p_size || '.png' || chr(10) || 'Alt text: f ' || p_size || '.png' || chr(10) || 'Image URL: https://team.atlassian.net/wiki/a/f%20' || p_size || '.png' ||
 chr(10) || chr(10) || 'Surrounding text:' || chr(10) || 'About ' || p_type AS page_content
FROM part""")
def images(spark, sf):
    tag = F.concat(F.lit('<img src="/wiki/a/f%20'), F.col("p_size").cast("string"), F.lit('.png">'))
    pages = d.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("u").alias("url"), F.lit("P").alias("space"),
        F.lit("Parts").alias("space_name"), F.concat(F.lit("P > "), "p_name").alias("breadcrumb"),
        F.concat(F.lit("<div><p>About "), "p_type", tag, F.lit("</p>"), tag, F.lit("</div>")).alias("body"))
    return prepare.image_rows(pages, d.SITE, d.BASE).select("page_id", "title", "image_url", "chunk_index", "page_content")


LISTING = {"id": "nullif(o_custkey, 3)", "side": "'orders'", "title": "concat('order of ', CAST(o_custkey AS STRING))"}  # BOTH
PRIMARY = {"id": "c_custkey", "side": "'customer'", "title": "c_name"}  # BOTH


def _listings(spark, sf):
    primary = d.pick(d.table(spark, sf, "customer"), PRIMARY).filter("id % 2 = 0")
    return primary, d.pick(d.table(spark, sf, "orders"), LISTING)


_L = (f"WITH p AS (SELECT {d.both(PRIMARY)} FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT {d.both(LISTING)} FROM orders)")


@query("i20_merge_by_id", _L + """
SELECT id, side, title FROM p UNION ALL SELECT DISTINCT id, side, title FROM f WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM p)""")
def merge_by_id(spark, sf):
    """The first listing holds every second customer, the second all customers with orders."""
    return prepare.merge_by_id(*_listings(spark, sf))


@query("i21_completeness", _L + """
SELECT (SELECT count(*) FROM p) AS primary_rows, (SELECT count(*) FROM f) AS fallback_rows,
  (SELECT count(*) FROM (SELECT id FROM p UNION SELECT id FROM f WHERE id IS NOT NULL)) AS merged_rows,
  (SELECT count(*) FROM (SELECT id FROM f WHERE id IS NOT NULL EXCEPT SELECT id FROM p)) AS fallback_only""")
def completeness(spark, sf):
    return prepare.completeness(*_listings(spark, sf))


@query("i21_listing_diff", _L + " SELECT id FROM f WHERE id IS NOT NULL EXCEPT SELECT id FROM p")
def listing_diff(spark, sf):
    return prepare.listing_diff(*_listings(spark, sf))


def _tree(spark, sf):
    """Regions are roots, nations sit below them, customers below both."""
    region = d.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.array().cast("array<string>").alias("ancestors"))
    r = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    nation = d.table(spark, sf, "nation")
    people = d.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return region.unionByName(nation.select(n.alias("id"), F.array(r).alias("ancestors"))).unionByName(
        people.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.array(r, n).alias("ancestors")))


@query("i22_descendants", """
SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS root FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def descendants(spark, sf):
    return prepare.descendants(_tree(spark, sf))


@query("i23_detail_override", """
SELECT o_orderkey AS id, coalesce(c_name, o_orderpriority) AS title, o_totalprice AS price, CASE WHEN c_custkey IS NOT NULL THEN 'database' END AS type
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_orderkey = c_custkey""")
def detail_override(spark, sf):
    listing = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    details = d.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return prepare.enrich(listing, details)


@query("i24_skipped_pages", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY 1 LIMIT 20")
def skipped_pages(spark, sf):
    pages = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    large = d.table(spark, sf, "orders").filter("o_totalprice > 400000")
    return prepare.skipped(pages, large.select(F.col("o_custkey").alias("page_id")))


# --- J: issues ---------------------------------------------------------------------------------------------------

JSON_VALUES = {  # BOTH
    "event_id": "event_id",
    "json": "CASE event_id % 6 WHEN 0 THEN concat('\" ', event_type, ' \"') WHEN 1 THEN concat('{\"self\":\"u\",\"value\":\"', event_type, '\"}') "
            "WHEN 2 THEN concat('[\"', event_type, '\",null,{\"displayName\":\"u', CAST(user_id AS STRING), '\"}]') WHEN 3 THEN 'true' "
            "WHEN 4 THEN concat('{\"n\":', CAST(user_id AS STRING), ',\"self\":\"x\",\"t\":\"', event_type, '\"}') ELSE CAST(user_id AS STRING) END",
}


@query("j1_json_value_text", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN event_type || ', u' || user_id WHEN 3 THEN 'true'
  WHEN 4 THEN 'n: ' || user_id || ', t: ' || event_type ELSE CAST(user_id AS VARCHAR) END AS text FROM events""")
def json_value_text(spark, sf):
    return d.pick(d.table(spark, sf, "events"), JSON_VALUES).select("event_id", richdoc.json_value_text("json").alias("text"))


@query("j2_custom_fields", """
SELECT l_orderkey AS key, string_agg(name || '=' || body, ',' ORDER BY first_id) AS fields FROM (
  SELECT l_orderkey, name, min(id) AS first_id, arg_max(body, id) AS body FROM (
    SELECT l_orderkey, 'customfield_' || l_linenumber AS id, CASE WHEN l_linenumber IN (1, 3) THEN 'Returned' WHEN l_linenumber < 5 THEN 'Line ' || l_linenumber
           ELSE 'customfield_' || l_linenumber END AS name, max(l_returnflag) AS body FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def custom_fields(spark, sf):
    line = d.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    entry = F.struct(F.concat(F.lit("customfield_"), F.col("l_linenumber").cast("string")), F.concat(F.lit('{"value":"'), "flag", F.lit('"}')))
    empty = F.array(F.struct(F.lit("customfield_9"), F.lit("[]")), F.struct(F.lit("summary"), F.lit('"s"')))
    rows = line.groupBy(F.col("l_orderkey").alias("key")).agg(F.map_from_entries(F.concat(F.collect_list(entry), empty)).alias("custom"))
    no = F.col("l_linenumber")
    name = F.when(no.isin(1, 3), "Returned").when(no < 5, F.concat(F.lit("Line "), no.cast("string"))).otherwise("")
    names = line.select(F.concat(F.lit("customfield_"), no.cast("string")).alias("id"), name.alias("name")).distinct()
    found = issues.custom_fields(rows, names)
    return found.select("key", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["text"])), ",").alias("fields"))


def _fields_sql(field):
    return (f"(contains(lower({field}.name), 'date') OR contains({field}.name, '날짜') OR contains({field}.name, '일자') OR contains({field}.name, '일시') "
            f"OR contains({field}.name, '점검일') OR regexp_matches({field}.text, '20[0-9]{{2}}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}|[0-9]{{1,2}}월\\s*[0-9]{{1,2}}일'))")


_dates = f"list_filter(fields, lambda f: {_fields_sql('f')})"


@query("j3_date_fields", s.build(
    f"SELECT key, array_to_string(list_transform({_dates}, lambda f: f.name || '=' || f.text), ',') AS date_fields FROM issues_", "issues_"))
def date_fields(spark, sf):
    found = issues.date_fields(F.col("fields"))
    return d.issues(spark, sf).select("key", F.array_join(F.transform(found, lambda f: F.concat(f["name"], F.lit("="), f["text"])), ",").alias("date_fields"))


CATEGORY = """CASE WHEN status_key = 'new' THEN 'todo' WHEN status_key = 'indeterminate' THEN 'in_progress' WHEN status_key = 'done' THEN 'done'
  WHEN regexp_matches(lower(status_name), 'done|closed|resolved|완료') THEN 'done' WHEN regexp_matches(lower(status_name), 'progress|진행') THEN 'in_progress' ELSE 'todo' END"""


@query("j4_status_category", s.build(f"SELECT key, {CATEGORY} AS category FROM issues_", "issues_"))
def status_category(spark, sf):
    return d.issues(spark, sf).select("key", status.issue_category(F.col("status_key"), F.col("status_name")).alias("category"))


s.cte("overview_", f"""
  SELECT * REPLACE (coalesce(assignee, 'unassigned') AS assignee, coalesce(reporter, 'unknown') AS reporter), {CATEGORY} AS status_category,
         coalesce(duedate, {_dates}[1].text) AS due_date FROM issues_""", "issues_")


@query("j5_overview", s.build(
    "SELECT key, summary, project_name, status_name, status_category, assignee, reporter, due_date FROM overview_", "overview_"))
def overview(spark, sf):
    return issues.overview(d.issues(spark, sf)).select(
        "key", "summary", "project_name", "status_name", "status_category", "assignee", "reporter", "due_date")


@query("j6_comments", """
SELECT l_orderkey AS key, count(*) AS kept, string_agg('- ' || CASE WHEN l_suppkey % 2 = 0 THEN 'unknown' ELSE 's' || l_suppkey END || ' at ' ||
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ': part ' || l_partkey, chr(10) ORDER BY n) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
WHERE n <= 3 AND l_returnflag <> 'N' GROUP BY 1""")
def comments(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("comment_no"),
        F.when(F.col("l_suppkey") % 2 == 1, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("author"),
        F.col("l_shipdate").cast("date").cast("string").alias("created"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("body"))
    found = issues.first_comments(rows, 3).withColumn("lines", issues.comment_lines(F.col("comments"), 3)).filter(F.size("lines") > 0)
    return found.select("key", F.size("lines").alias("kept"), F.array_join("lines", "\n").alias("lines"))


s.cte("issue_text_", """
  SELECT *, concat_ws(chr(10), 'Content type: jira_issue', 'Issue key: ' || key, 'Title: ' || summary, 'Project: ' || project_name, 'Issue type: unknown',
    'Status: ' || status_name, 'Status category: ' || status_category, 'Priority: ' || priority, 'Assignee: ' || assignee, 'Reporter: ' || reporter,
    'Created: ' || created, 'Updated: ' || updated, 'Due date: ' || due_date, '', 'Custom fields indexed: 2',
    array_to_string(list_transform(fields, lambda f: f.name || ': ' || f.text), chr(10))) AS text FROM overview_""", "overview_")
s.cte("issue_chunks_", f"""
  SELECT key || ':' || i AS chunk_id, key AS page_id, key || ' ' || summary AS title, '/browse/' || key AS url, project AS space, project_name AS space_name,
    project_name || ' > ' || key AS breadcrumb, 'jira_issue' AS content_type, 'jira' AS source_type, key AS issue_key, status_name AS issue_status,
    status_category AS issue_status_category, assignee, reporter, due_date, updated, created, {_dates} AS date_fields, CAST(i AS INT) AS chunk_index,
    'Chunk: ' || (i + 1) || '/' || ((greatest(1, length(text) - 150) - 1) // 650 + 1) || chr(10) || chr(10) || 'Content:' || chr(10) || substring(text, 1 + 650 * i, 800) AS page_content
  FROM (SELECT *, unnest(range(0, (greatest(1, length(text) - 150) - 1) // 650 + 1)) AS i FROM issue_text_)""", "issue_text_")


def issue_chunk_table(spark, sf, newest=None):
    rows = issues.overview(d.issues(spark, sf, dealt=True))
    if newest:
        rows = issues.newest(rows, newest)
    return issues.issue_chunks(rows, pieces=splitter.stride_chunks(F.col("text")))


@query("j7_issue_chunks", s.build(
    "SELECT chunk_id, title, url, breadcrumb, issue_status_category, due_date, md5(page_content) AS content FROM issue_chunks_", "issue_chunks_"))
def issue_chunks(spark, sf):
    return issue_chunk_table(spark, sf).select(
        "chunk_id", "title", "url", "breadcrumb", "issue_status_category", "due_date", F.md5("page_content").alias("content"))


s.cte("newest_", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY updated DESC, key) AS newest_no FROM overview_) WHERE newest_no <= 1000""",
      "overview_")
_line = ("'- ' || key || ': ' || summary || ' (status=' || status_name || '; assignee=' || assignee || '; updated=' || updated || "
         "coalesce('; due_date=' || due_date, '') || ')'")


_sections = {"todo": "To do", "in_progress": "In progress", "done": "Done"}
_n = {c: f"n_{c}" for c in _sections}
_heads = [("0", "0", str(i), text) for i, text in enumerate([
    "'Content type: jira_project_status_summary'", "'Project: ' || project_name || ' (' || project || ')'", "'Total issues indexed: ' || issues",
    "'Status category counts: To do=' || n_todo || ', In progress=' || n_in_progress || ', Done=' || n_done", "''"])]
for _i, (_c, _label) in enumerate(_sections.items(), 1):
    _before = " + ".join(["0", *list(_n.values())[:_i - 1]])
    _first, _last = f"greatest(0, {_before} + least({_n[_c]}, 1) - 1) // {fv.MAX_ISSUES}", f"greatest(0, {_before} + {_n[_c]} - 1) // {fv.MAX_ISSUES}"
    _heads += [(_first, str(_i), "0", f"'{_label} issues (' || {_n[_c]} || '):'"), (_first, str(_i), "1", f"CASE WHEN {_n[_c]} = 0 THEN '- None' END"),
               (_last, str(_i), "1000000000000", "''")]
s.cte("summary_lines_", f"""
  SELECT project, (place - 1) // {fv.MAX_ISSUES} AS part_no, section, place, line FROM (
    SELECT project, CASE status_category WHEN 'todo' THEN 1 WHEN 'in_progress' THEN 2 ELSE 3 END AS section, {_line} AS line,
      row_number() OVER (PARTITION BY project ORDER BY CASE status_category WHEN 'todo' THEN 1 WHEN 'in_progress' THEN 2 ELSE 3 END, updated DESC, key) AS place
    FROM overview_)""", "overview_")
s.cte("summary_counts_", """
  SELECT project, min(project_name) AS project_name, count(*) AS issues, count(*) FILTER (status_category = 'todo') AS n_todo,
    count(*) FILTER (status_category = 'in_progress') AS n_in_progress, count(*) FILTER (status_category = 'done') AS n_done FROM overview_ GROUP BY project""", "overview_")
s.cte("summary_", f"""
  SELECT project, project_name, CAST(part_no AS INT) AS part_no, issues, n_todo AS todo, n_in_progress AS in_progress, n_done AS done, text FROM (
    SELECT project, part_no, string_agg(line, chr(10) ORDER BY section, place) AS text FROM (
      SELECT * FROM summary_lines_ {' '.join(f"UNION ALL SELECT project, {part}, {section}, {place}, {text} FROM summary_counts_" for part, section, place, text in _heads)})
    WHERE line IS NOT NULL GROUP BY 1, 2) JOIN summary_counts_ USING (project)""", "summary_lines_", "summary_counts_")


# an order as a landed issue: rich description and comments, custom values as plain text
_extra = ("chr(10) || chr(10) || 'Description:' || chr(10) || 'Order ' || key || ' of ' || project || chr(10) || chr(10) || "
          "'Comments indexed: 1' || chr(10) || '- ' || reporter || ' at ' || created || ': seen ' || key")


@query("plan_ingest_issues", s.build(f"""
SELECT key || ':0' AS chunk_id, project AS space, 'run2' AS ingest_run_id, status_category AS issue_status_category, due_date,
       'Chunk: 1/1' || chr(10) || chr(10) || 'Content:' || chr(10) || text || {_extra} AS page_content FROM issue_text_""", "issue_text_"))
def ingest_issues(spark, sf):
    """Landed issues of every project to the published chunk table, one snapshot per project; the second run replaces the first."""
    text_ = lambda *words: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.concat(*words).alias("text"))).alias("content"))
    doc = lambda *blocks: F.struct(F.lit("doc").alias("type"), F.array(*blocks).alias("content"))
    even = F.regexp_extract("key", r"(\d+)$", 1).cast("long") % 2 == 0
    # the first field has one of two names, so it is one of two fields
    raw = _issue_json(spark, sf).withColumn("first", F.col("fields.customfield_10001"))
    raw = raw.withColumn("fields", F.col("fields").dropFields("customfield_10001")).withColumn("fields", F.struct(
        "fields.*", F.when(~even, F.col("first")).alias("customfield_10000"), F.when(even, F.col("first")).alias("customfield_10001"), doc(text_(F.lit("Order "), F.col("key")), text_(F.lit("of "), F.col("project"))).alias("description"),
        F.struct(F.array(F.struct(F.col("fields.reporter").alias("author"), F.col("fields.created").alias("created"),
                                  doc(text_(F.lit("seen "), F.col("key"))).alias("body")),
                         F.struct(F.col("fields.reporter").alias("author"), F.col("fields.created").alias("created"), doc(text_(F.lit(""))).alias("body"))).alias("comments")).alias("comment")))
    folder = work_dir(spark)
    raw.drop("first").write.partitionBy("project").option("compression", "gzip").json(f"{folder}/landed")
    names = spark.createDataFrame([("customfield_10000", "담당팀"), ("customfield_10001", "점검일"), ("customfield_10002", "Target Date")], "id string, name string")
    every = ingest.Place(F.col("project"))
    # read by both runs and by the summaries: parsed and joined once
    overviews = stage(ingest.issue_overviews(spark, f"{folder}/landed", every, names), "overviews")
    chunks = ingest.issue_chunks(overviews, every)
    ingest.publish(chunks, f"{folder}/chunks", "run1")
    ingest.publish(chunks, f"{folder}/chunks", "run2")
    rows = snapshot.read_table(spark, f"{folder}/chunks").filter("content_type = 'jira_issue'")
    return rows.select("chunk_id", F.col("space").cast("string").alias("space"), "ingest_run_id", "issue_status_category", "due_date", "page_content")


@query("plan_ingest_pages", s.build(f"""
SELECT c_custkey || ':' || chunk_index AS chunk_id, c_mktsegment AS space, 'run2' AS ingest_run_id, CAST(chunk_index AS INT) AS chunk_index, c_name AS title, crumb AS breadcrumb,
  CASE WHEN c_custkey % 3 = 0 THEN '{d.SITE}/wiki/spaces/' || c_mktsegment || '/pages/' || c_custkey ELSE '{d.BASE}/pages/viewpage.action?pageId=' || c_custkey END AS url,
  md5('Content type: page' || chr(10) || 'Space: Space ' || c_mktsegment || ' (' || c_mktsegment || ')' || chr(10) || 'Document location: ' || crumb || chr(10) || chr(10) ||
    'Chunk: ' || (chunk_index + 1) || '/' || chunk_count || chr(10) || chr(10) || 'Content:' || chr(10) || piece) AS page_content
FROM note_chunks_""", "note_chunks_"))
def ingest_pages(spark, sf):
    """Landed pages of every space to the published chunk table: notes of several chunks, a link named after its issue, a table.

    Customers without orders are pages without a body; they give no chunk.
    """
    notes = d.order_notes(spark, sf).withColumnRenamed("page", "c_custkey")
    rows = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderkey").alias("last_order"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("cells"))
    pages = d.table(spark, sf, "customer").join(_nation_path(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).join(
        notes, "c_custkey", "left").join(rows, "c_custkey", "left")
    each = lambda c, use: F.array_join(F.transform(c, use), "")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    issue = F.concat_ws("-", "c_mktsegment", F.col("last_order").cast("string"))
    body = F.concat(
        F.lit("<h2>Notes</h2>"), each("notes", lambda n: tag("p", n)), F.lit('<p>See <a class="jira-issue" data-issue-key="'), issue, F.lit('">'), issue,
        F.lit("</a></p><table><tr><th>no</th><th>flag</th></tr>"),
        each("cells", lambda c: tag("tr", F.concat(tag("td", c["o_orderkey"].cast("string")), tag("td", c["o_orderstatus"])))), F.lit("</table>"))
    page_id, viewed = F.col("c_custkey").cast("string"), F.col("c_custkey") % 2 == 0
    value = lambda c: F.struct(c.alias("value"))
    raw = pages.select(
        page_id.alias("id"), F.col("c_name").alias("title"), F.lit("page").alias("type"), "ancestors",
        F.struct(value(F.when(viewed, body).otherwise("")).alias("export_view"), value(F.when(~viewed, body)).alias("storage")).alias("body"),
        F.struct(F.when(F.col("c_custkey") % 3 == 0, F.concat_ws("/", F.lit("/wiki/spaces"), "c_mktsegment", F.lit("pages"), page_id)).alias("webui")).alias("_links"),
        F.col("c_mktsegment").alias("space"))
    folder = work_dir(spark)
    raw.write.partitionBy("space").option("compression", "gzip").json(f"{folder}/landed")
    known = issues.overview(d.issues(spark, sf))
    projects = d.issues(spark, sf).select(F.col("project").alias("key"), F.col("project_name").alias("name")).distinct()
    place = ingest.Place(F.col("space"), F.concat(F.lit("Space "), "space"), d.SITE, d.BASE)
    chunks = ingest.page_chunks(spark, f"{folder}/landed", place, known, projects)
    sources = d.table(spark, sf, "customer").select(F.lit(fv.WIKI).alias("source_type"), F.col("c_mktsegment").alias("space")).distinct()
    ingest.publish(chunks, f"{folder}/chunks", "run1", sources)
    ingest.publish(chunks, f"{folder}/chunks", "run2", sources)
    rows = snapshot.read_table(spark, f"{folder}/chunks")
    return rows.select("chunk_id", F.col("space").cast("string").alias("space"), "ingest_run_id", "chunk_index", "title", "breadcrumb", "url", F.md5("page_content").alias("page_content"))


@query("j8_project_summary", s.build(
    "SELECT project, part_no, issues, todo, in_progress, done, md5(text) AS text FROM summary_", "summary_"))
def project_summary(spark, sf):
    rows = issues.project_summary(issues.overview(d.issues(spark, sf)))
    return rows.select("project", "part_no", "issues", "todo", "in_progress", "done", F.md5("text").alias("text"))


@query("j9_newest_issues", s.build("SELECT key, newest_no FROM newest_", "newest_"))
def newest_issues(spark, sf):
    return issues.newest(d.issues(spark, sf), fv.MAX_ISSUES).select("key", "newest_no")


@query("j10_field_dictionary", """
SELECT l_shipdate::DATE::VARCHAR AS id, max(l_returnflag || l_linestatus) AS name FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def field_dictionary(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("id"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("name"))
    return issues.field_dictionary(rows)


# --- C: catalogue ---------------------------------------------------------------------------------------------------

@query("c1_source_statistics", s.build("""
SELECT source_type, space, count(*) AS chunks, arg_min(CASE WHEN chunk_index % 2 = 1 THEN space_name END, chunk_id)
  FILTER (chunk_index % 2 = 1) AS space_name
FROM (SELECT * REPLACE (CASE WHEN chunk_index % 3 = 0 THEN 'confluence' ELSE 'jira' END AS source_type) FROM chunks_) GROUP BY 1, 2""", "chunks_"))
def source_statistics(spark, sf):
    odd = F.col("chunk_index") % 2 == 1
    kind = F.when(F.col("chunk_index") % 3 == 0, F.lit(None)).otherwise("jira")
    rows = d.chunks(spark, sf).withColumn("space_name", F.when(odd, F.col("space_name")).otherwise("")).withColumn("source_type", kind)
    return catalogue.source_statistics(rows)


HISTORY = {  # BOTH
    "source_type": "CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'other' ELSE 'jira' END",
    "space": "concat('sp', CAST(user_id AS STRING))", "space_name": "CASE WHEN user_id % 3 = 0 THEN concat('Space ', CAST(user_id AS STRING)) ELSE '' END",
    "chunks": "event_id", "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END", "run_at": "ts",
}
RESTORED = {"source_type": "CASE WHEN user_id % 4 = 0 THEN 'confluence' WHEN user_id % 4 = 1 THEN 'other' ELSE 'jira' END",
            "space": "concat('sp', CAST(user_id AS STRING))"}  # BOTH


def _restored(spark, sf):
    rows = d.pick(d.table(spark, sf, "events"), {**RESTORED, "event_type": "event_type"}).filter("event_type IN ('click', 'view')")
    return rows.groupBy("source_type", "space").agg(F.concat(F.lit("R"), F.max("space")).alias("space_name"), F.count("*").alias("chunks"))


def _runs(spark, sf):
    return d.pick(d.table(spark, sf, "events"), {**HISTORY, "event_type": "event_type"}).filter("event_type <> 'view'").drop("event_type")


_H = f"""WITH h AS (SELECT {d.both({**HISTORY, "source_type": "coalesce(" + HISTORY["source_type"] + ", 'confluence')"})} FROM events WHERE event_type <> 'view'),
r AS (SELECT {d.both(RESTORED)}, 'R' || max('sp' || user_id) AS space_name, count(*) AS chunks FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
l AS (SELECT source_type, space, arg_max(space_name, run_at) AS space_name, arg_max(chunks, run_at) AS chunks, arg_max(status, run_at) AS status FROM h GROUP BY 1, 2)"""


@query("c2_merge_history", _H + """
SELECT source_type, space, coalesce(nullif(l.space_name, ''), r.space_name) AS space_name, coalesce(l.chunks, r.chunks) AS chunks,
       coalesce(status, 'indexed') AS status FROM l FULL JOIN r USING (source_type, space)""")
def merge_history(spark, sf):
    return catalogue.merge_history(_runs(spark, sf), _restored(spark, sf))


@query("c3_reindex_targets", _H + """
SELECT source_type, space, min(space_name) AS space_name FROM h WHERE source_type IN ('confluence', 'jira') GROUP BY 1, 2""")
def reindex_targets(spark, sf):
    return catalogue.reindex_targets(_runs(spark, sf))


_OUT = _H + """, t AS (SELECT DISTINCT source_type, space FROM r WHERE source_type IN ('confluence', 'jira')),
o AS (SELECT source_type, space, chunks, status FROM l),
x AS (SELECT t.*, CASE WHEN o.status = 'success' THEN o.chunks ELSE 0 END AS chunks, CASE WHEN o.status = 'success' THEN 'success' ELSE 'failed' END AS status
      FROM t LEFT JOIN o USING (source_type, space))"""


def _results(spark, sf):
    latest = catalogue.merge_history(_runs(spark, sf), _restored(spark, sf).limit(0))
    outcomes = latest.select("source_type", "space", "chunks", F.when(F.col("status") == "failed", "boom").alias("error"))
    return catalogue.run_results(catalogue.reindex_targets(_restored(spark, sf)), outcomes, "slot-1")


@query("c4_run_results", _OUT + " SELECT source_type, space, chunks, status FROM x")
def run_results(spark, sf):
    return _results(spark, sf).select("source_type", "space", "chunks", "status")


@query("c4_run_totals", _OUT + """
SELECT 'slot-1' AS schedule_slot, count(*) AS total, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status = 'failed') AS failed,
  CAST(sum(chunks) AS BIGINT) AS chunks, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'idle_with_errors' ELSE 'idle' END AS run_status FROM x""")
def run_totals(spark, sf):
    return catalogue.run_totals(_results(spark, sf))


@query("r35_round_robin", """
WITH a AS (SELECT 's' || s_suppkey AS key, row_number() OVER (ORDER BY 's' || s_suppkey) AS rank, 0 AS list_no FROM supplier),
b AS (SELECT 'c' || c_custkey AS key, row_number() OVER (ORDER BY 'c' || c_custkey) AS rank, 1 AS list_no FROM customer)
SELECT key FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY rank, list_no LIMIT 15""")
def round_robin(spark, sf):
    key = lambda t, c, p: d.table(spark, sf, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("key")).orderBy("key").limit(15)
    return catalogue.interleave(key("supplier", "s_suppkey", "s"), key("customer", "c_custkey", "c"), 15).select("key")


@query("r36_name_search", """
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer
WHERE contains(lower(c_name), 'r#00000001') OR contains(CAST(c_custkey AS VARCHAR), 'r#00000001') ORDER BY 1 LIMIT 10""")
def name_search(spark, sf):
    rows = d.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.lit("jira").alias("source_type"))
    return catalogue.name_search(rows, " R#00000001 ").select("key", "name")
