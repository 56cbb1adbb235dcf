"""What is written, dealt and parsed grows with the input only."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import html
from corpusloom import fixed_values as fv
from corpusloom.operators import issue_summary, issues, mention_context, ranking, scope
from corpusloom.sources import log_sink
from suite import domain, ingest_queries


def tree(node):
    out = []
    for kid in node.kids:
        if isinstance(kid, str) and out and isinstance(out[-1], str):
            out[-1] += kid
        else:
            out.append(kid if isinstance(kid, str) else (kid.tag, kid.attrs, tree(kid)))
    return out


def test_plain_markup_has_the_standard_tree():
    pick, seen = random.Random(5), 0
    parts = ["<p>", "</p>", "<P>", "<br>", "<br />", '<a href="x y" Class="jira-issue">', "</a>", "<a href=x>", "<td\n x=\"y\">", "</TR>", "text", "\n", "한글", "&amp;",
             "<!-- c -->", "<script>", "</script>", "<", ">", "<p/>", "</p >", '<p x="1"y="2">', '<p\xa0x="1">', "<title>", "<a b>", "<x:y>"]
    for _ in range(20000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 8)))
        standard = html._Builder()
        standard.feed(text)
        standard.close()
        assert tree(html.parse(text)) == tree(standard.root), text
        seen += "&" not in text and html._parse_plain(text) is not None
    assert seen > 1000


def test_linked_pages_are_dealt_over_the_cores(spark, tmp_path):
    spark.createDataFrame([(i, i % 5) for i in range(200)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, "BUILDING") for i in range(5)], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = ingest_queries._linked_orders(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and rows.count() == 200


def test_pieces_of_a_summary_stand_without_its_text(spark, monkeypatch):
    written = []
    monkeypatch.setattr(issues, "stage", lambda df, name: written.append(df.columns) or df)
    parts = spark.createDataFrame([("P", "Project", i, 9, 3, 3, 3, f"line {i}\n" * 300) for i in range(3)],
                                  "project string, project_name string, part_no int, issues long, todo int, in_progress int, done int, text string")
    rows = issues.summary_chunks(parts).orderBy("chunk_index").collect()
    assert written and all("text" not in columns for columns in written)
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) > 6


def test_a_field_name_keeps_its_first_place_and_last_text(spark):
    rows = spark.createDataFrame([("a", {"customfield_3": '"z"', "customfield_1": '"x"', "customfield_2": '"y"', "summary": '"s"'}), ("b", {"customfield_2": '""'})],
                                 "key string, custom map<string,string>")
    names = spark.createDataFrame([("customfield_1", "N"), ("customfield_3", "N")], "id string, name string")
    got = issues.custom_fields(rows, names)
    # names and keys are brought together by one shuffle
    assert not re.search(r"hashpartitioning\(key#\d+, name", got._jdf.queryExecution().executedPlan().toString())
    assert [(r.key, [tuple(f) for f in r.fields]) for r in got.collect()] == [("a", [("customfield_1", "N", "z"), ("customfield_2", "customfield_2", "y")])]


def test_a_day_of_the_log_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        rows = spark.range(40000).select(F.lit("2026-01-02T03:04:05").alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("question")).coalesce(1)
        assert log_sink.append(rows, f"{tmp_path}/log", batch="0")
    finally:
        spark.conf.set(size, before)
    assert len(list(tmp_path.glob("log/log_date=2026-01-02/*/*/part-*"))) > 1
    assert log_sink.read_log(spark, f"{tmp_path}/log", "question string").count() == 40000


def test_the_chunk_table_is_written_without_a_shuffle_of_its_rows(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"title {i}\n" + "word " * 400, "en", "src1") for i in range(300)], "doc_id long, text string, lang string, source string")
    rows.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(domain, "stage", lambda df, name: df)
    monkeypatch.setattr(domain, "_STORED", {})
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a split for each file
    try:
        found = domain.chunks(spark, str(tmp_path))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 300 * 3
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scores_of_a_space_read_no_dates(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(mention_context, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or df)
    chunks = spark.createDataFrame([(f"c{i}", "s", "Alpha-Beta 24-03 " * 400, "en > alpha", "beta gamma", "page", "wiki") for i in range(3)],
                                   "chunk_id string, space string, title string, breadcrumb string, page_content string, content_type string, source_type string")
    mentions, terms = spark.createDataFrame([("q", "s")], "query_id string, space string"), spark.createDataFrame([("q", "alpha"), ("q", "beta"), ("q", "delta")], "query_id string, term string")
    got = mention_context.space_scores(mentions, terms, chunks).collect()
    assert sorted(map(tuple, got)) == [("q", f"c{i}", 3 + 2 + 3 + 1) for i in range(3)]
    assert all("regexp" not in plan for name, plan in plans if name == "posted") and "posted" in dict(plans)


def _issue_chunk(spark, rows):
    return spark.createDataFrame(
        [(f"{k}:{i}", k, "P", "Project", title, "jira_issue", "jira", k, "Open", "todo", None, due, None, None, fields, text) for k, i, title, due, fields, text in rows],
        "chunk_id string, page_id string, space string, space_name string, title string, content_type string, source_type string, issue_key string, issue_status string, "
        "issue_status_category string, assignee string, due_date string, updated string, created string, jira_date_fields map<string,string>, page_content string")


def test_matches_behind_issue_tables_are_made_once(spark):
    chunks = _issue_chunk(spark, [(f"P-{i}", n, "점검", "2024-03-0%d" % (i % 9 + 1), {}, f"Updated: 2024-03-{i % 20 + 10}") for i in range(30) for n in range(2)])
    asked = issue_summary.requests(spark.createDataFrame([("q", "P")], "query_id string, space string"), spark.createDataFrame([("q", "3월 4월 점검 이슈")], "query_id string, query string"))
    rows = issue_summary.issue_rows(asked, chunks)
    docs = issue_summary.summary_documents(rows, asked, spark.createDataFrame([("q", "3월 4월 점검 이슈")], "query_id string, query string"), size=20)
    assert "explode(concat" not in docs._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, docs.select("part_no", "issue_count", "page_content").collect()))
    assert [(a, b, c.count("| P-")) for a, b, c in got] == [(0, 30, 20), (1, 30, 10)]
    assert issue_summary.matching_issue_chunks(asked, chunks).count() == 60


def test_months_are_the_first_of_each_pattern_in_each_text(spark):
    pick = random.Random(3)
    parts = ["2024-03-01", "24.05", "24-11-3", "x24-07", "가24-08", " ", "\n", "Updated: ", "Due date:", "Date:\n", "Created:", "\r\n", "12", "-", "24_09-1", "é"]
    text = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(0, 7)))
    rows = [(f"P-{i}", 0, pick.choice([None, text()]), pick.choice([None, text()]), pick.choice([None, {}, {"a": text(), "b": None}]), pick.choice([None, text() + "\n" + text() + "\n" + text()])) for i in range(3000)]
    end, blank = "[^\n\r\u0085\u2028\u2029]", "[ \t\n\x0b\f\r]"
    expected = {}
    for key, _, title, due, fields, content in rows:
        lines = [re.search(rf"(?:^|(?<=[\n\r\u0085\u2028\u2029])){n}:{blank}*({end}+)", content or "") for n in ("Updated", "Created", "Due date", "Date")]
        texts = [due, *(fields or {}).values(), *(x and x[1] for x in lines), title]
        expected[key] = sorted({int(found[1]) for t in texts if t for p in (fv.ISSUE_DATE_MONTH, fv.ISSUE_TITLE_MONTH) if (found := re.search(p, t))})
    got = {r.issue: r.months for r in scope.issue_facts(_issue_chunk(spark, rows)).collect()}
    assert got == expected and sum(len(m) > 1 for m in got.values()) > 100


def test_places_need_no_second_sort(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    got = ranking.placed(rows, ["k"], [F.desc("v")])
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.select("k", "v", "place").collect())) == sorted(map(tuple, ranking.numbered(rows, ["k"], [F.desc("v")], "place").collect()))
