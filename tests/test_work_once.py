"""Texts are read, searched and normalised once, and results stay those of the plain rules."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import korean
from corpusloom.functions.text import normalize
from corpusloom.operators import keyword, matching, scope, status_search


def test_what_chunks_of_a_page_share_is_searched_once(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab회") for _ in range(n))
    pages = [(text(300), text(40)) for _ in range(3)]
    rows = [(*pages[i % 3], text(50)) for i in range(30)]
    terms = ["a", "aa", "ab", "회", "aba", "b회a", "aaaa", "abab회", "회회ab"]
    made = matching.term_filter(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert made.prefixes
    read, find = [], matching.find
    monkeypatch.setattr(keyword, "find", lambda segments, *rest: read.append(sum(map(len, segments))) or find(segments, *rest))
    raw = [[x.encode() for x in column] for column in zip(*((t, k, c, t + "a" + c) for t, k, c in rows), strict=True)]
    facts = keyword._block_facts(*raw, made).to_pylist()
    assert sum(read) < 6 * sum(len(t.encode()) for t, _ in pages) + 3 * sum(map(len, raw[2]))
    for (title, words, content), found in zip(rows, facts, strict=True):
        gate, head = title + "a" + content, title + words
        want = {t: (t in gate, t in head, title.count(t), words.count(t), content.count(t)) for t in terms if t in gate or t in head}
        assert {f["term"]: tuple(f.values())[1:] for f in found if f["term"] in terms} == want


def test_what_is_found_is_packed_where_it_is_found(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(keyword, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or df)
    texts = spark.createDataFrame([("c", "p", "ab", "ab", "ab cd", [1], "ab ab cd")], "chunk_id string, page_id string, title string, keyword string, content string, months array<int>, gate string")
    keyword._scanned_blocks(texts, spark.createDataFrame([("ab",)], "term string"))
    assert dict(plans)["scanned_blocks"].split("Initial Plan")[0].count("MapInArrow") == 2  # single rows and copies


def test_long_texts_get_the_dates_of_the_column_rules(spark):
    rng = random.Random(3)
    bits = ["2024", "24", "년", "월", "일", "주차", "w", "W", " ", "-", ".", "_", "1", "2", "12", "13", "31", "05", "0", "a", "é", "가", "회의", "\n", "240512", "0512",
            " ", "ª", "́", "\x1c", "٣", "24년 3월 2일자", "2024-3-1", "3월 2주차"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts[:50], ""]], "t string")
    t = F.col("t")
    assert rows.filter(~korean.searchable_long(t, 2026).eqNullSafe(korean.searchable(t, 2026)) | ~korean.locator_months_long(t).eqNullSafe(korean.locator_months(t))).count() == 0
    usual = [x for x in texts if korean._searched(x, 2026) is not None]
    assert len(usual) > 300 and len(usual) < len(texts)


def test_chunks_are_read_once_for_typed_mentions(spark):
    rows = [("1", "confluence", "src 1", "Space One", "en > src 1", "src1 text"), ("2", None, "src 2", "", "en", "src 1"), ("3", "jira", "src", "x", "SRC1", "none"), ("3", "jira", "src", "x", "SRC1", "none"),
            ("4", "jira", "", "src 1", "src1", "src1"), (None, "jira", "other", "src1", "src1", "src1")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_type string, space string, space_name string, breadcrumb string, page_content string")
    queries = spark.createDataFrame([("q", "SRC 1"), ("r", "src-1"), ("s", "one"), ("t", "!")], "query_id string, query string")
    found = scope.mention_search(queries, chunks)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.query_id, r["rank"], r.space, r.space_name, r.score) for r in found.collect()) == [
        ("q", 1, "src 1", "Space One", 115), ("q", 2, "src", "x", 25), ("q", 3, "src 2", "src 2", 10),
        ("r", 1, "src 1", "Space One", 115), ("r", 2, "src", "x", 25), ("r", 3, "src 2", "src 2", 10), ("s", 1, "src 1", "Space One", 60), ("s", 2, "src", "x", 10)]


def test_issue_texts_are_normalised_without_a_pattern_per_field(spark):
    fields = ["title", "breadcrumb", "space", "space_name", "page_content"]
    rows = [("c1", None, "jira", "jira_issue", "todo", "T-1 가나", "B > 회의", None, "S p", "Ab, 회의İ: é 12\n"), ("c2", "p", "jira", "jira_issue", None, None, None, None, None, "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, page_id string, source_type string, content_type string, issue_status_category string, " + ", ".join(f"{c} string" for c in fields))
    texts = status_search._texts(chunks)
    assert "regexp_replace" not in texts._jdf.queryExecution().optimizedPlan().toString()
    want = chunks.select("chunk_id", F.concat(*[normalize(F.col(c)) for c in fields]).alias("text"))
    assert texts.select("chunk_id", "text").exceptAll(want).count() == 0 and texts.count() == 2


def test_issues_are_matched_once_for_named_and_implied_projects(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scope, "stage", lambda df, name: kept.append(name) or spark.createDataFrame(df.collect(), df.schema))
    rows = [(f"A-{i}:0", f"A-{i}", "jira", "jira_issue", "AB", "AB Maintenance", f"A-{i}", "todo", "Open", None, "2024-05-01", "2024-05-01", None, f"A-{i} 24-05 점검", "Status: Open") for i in range(3)]
    rows += [("B-1:0", "B-1", "jira", "jira_issue", "CD", "CD", "B-1", "todo", "Open", None, "2024-05-01", "2024-05-01", None, "B-1 점검", "Status: Open")]
    chunks = spark.createDataFrame(rows, "chunk_id string, page_id string, source_type string, content_type string, space string, space_name string, issue_key string, issue_status_category string, "
                                         "issue_status string, due_date string, updated string, created string, jira_date_fields map<string,string>, title string, page_content string")
    queries = spark.createDataFrame([("n", "CD 5월 점검 이슈"), ("i", "5월 점검 이슈")], "query_id string, query string")
    found = scope.infer_scopes(queries, chunks)
    assert kept == ["counted"] and "jira_issue" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r["rank"], r.space, r.score) for r in found.collect()) == [("i", 1, "AB", 3), ("i", 2, "CD", 1), ("n", 1, "CD", 101)]
