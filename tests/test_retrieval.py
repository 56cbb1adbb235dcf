"""Golden cases of retrieval, questions, context and evaluation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import followup, korean, routing
from corpusloom.operators import context, evaluation, fusion, history, issue_summary, keyword, matching, mention_context, scope, vector
from corpusloom.plans import retrieve
from corpusloom.sources import landed, schemas, snapshot
from corpusloom.streaming import log_statistics
from corpusloom.operators.query_log import route_statistics

NOW = 2026


def chunk_rows(spark, rows):
    base = spark.createDataFrame([], schemas.CHUNK)
    names = base.columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], base.schema)


def questions(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def test_terms_routes_buckets_and_reuse(spark):
    q = questions(spark, "26년 5월 26일자로 기술회의록 알려줘", "26년 5월 4주차 홍길동 주간보고 요약해줘")
    exact = [r.t for r in q.orderBy("query_id").select(korean.exact_terms(F.col("query"), NOW).alias("t")).collect()]
    broad = q.orderBy("query_id").select(korean.broad_terms(F.col("query")).alias("t")).first().t
    assert "0526" in exact[0] and "260526주차" not in exact[0] and "26054주차" in exact[1] and "기술회의" in broad
    routes = {
        "사내 전결 규정 알려줘": "exact_lookup", "5월 1주차~5주차 주간보고 표로 정리해줘": "multi_doc_summary",
        "SAMPLE_APP V2 성능지표 문서에서 TPS 값 알려줘": "long_doc_lookup", "관련 문서 알려줘": "broad_exploration"}
    got = questions(spark, *routes).select("query", routing.route(F.col("query"), F.lit(False))["name"].alias("r"))
    assert {r.query: r.r for r in got.collect()} == routes
    plan = questions(spark, "홍길동 3분기 보고서 요약해줘", "홍길동 5월 1주차~3주차 주간보고", "홍길동 5월 4주차 주간보고")
    got = [[(b.label, b.query) for b in r.b] for r in plan.orderBy("query_id").select(routing.time_buckets(F.col("query")).alias("b")).collect()]
    assert got[0][0] == ("7월", "홍길동 7월 보고서 요약해줘") and len(got[0]) == 3
    assert [b[1] for b in got[1]] == [f"홍길동 5월 {w}주차 주간보고" for w in (1, 2, 3)] and got[2][0][0] == "single"
    reuse = questions(spark, "다른 사람은?", "홍길동 주간보고 요약해줘").orderBy("query_id").select(
        followup.reuses_prior_sources(F.col("query"), F.lit(False)).alias("r"))
    assert [r.r for r in reuse.collect()] == [True, False]


@pytest.mark.parametrize("block", [1024, 8])
def test_followups_and_block_splitting(spark, block):
    first = "홍길동의 5월 4주차 주간보고 요약해줘"
    turns = [("a", 0, "user", first), ("a", 1, "assistant", "박민수 3월"), ("a", 2, "user", "3주차도 보여줘"),
             ("b", 0, "user", first), ("b", 1, "user", "이영희 것도 보여줘"), ("c", 0, "user", first), ("c", 1, "user", "표로 정리해줘")]
    turns += [("d", i, "user", first if i == 9 else "표로 정리해줘" if i != 14 else "3주차도 보여줘") for i in range(30)]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, content string")
    got = {(r.conv_id, r.turn): r.resolved for r in history.carry_anchors(df, block=block).collect()}
    assert got["a", 2].retrieval_query == "홍길동 5월 3주차 주간보고" and got["a", 2].scope_changed
    assert got["b", 1].retrieval_query == "이영희 5월 4주차 주간보고"
    assert got["c", 1].retrieval_query == "표로 정리해줘" and not got["c", 1].scope_changed
    assert got["d", 14].retrieval_query == "홍길동 5월 3주차 주간보고" and len([k for k in got if k[0] == "d"]) == 30


@pytest.mark.parametrize("block", [1024, 4])
def test_anchors_that_stand_only_in_sources(spark, block):
    turns = [("a", i, "assistant" if i % 2 else "user", "표로 정리해줘") for i in range(12)] + [("b", 0, "user", "3주차도 보여줘")]
    turns = [t if t[:2] != ("a", 10) else ("a", 10, "user", "3주차도 보여줘") for t in turns]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, content string")
    cited = [("a", 1, 0, "이영희 2월 1주차 회의록"), ("a", 3, 0, "홍길동의 5월 4주차"), ("a", 3, 1, "박민수 6월 주간보고"), ("a", 11, 0, "김철수 9월"), ("b", 4, 0, "김철수 9월")]
    sources = spark.createDataFrame(cited, "conv_id string, turn long, position int, text string")
    got = {(r.conv_id, r.turn): r.resolved for r in history.carry_anchors(df, block=block, sources=sources, last=2, frame=2).collect()}
    # of the last two sources the older one names subject and month, the newer one the kind of document
    assert got["a", 10].retrieval_query == "홍길동 5월 3주차 주간보고" and got["a", 10].scope_changed
    assert not got["b", 0].scope_changed and not got["a", 8].scope_changed and len(got) == 7
    now = {r.query_id: r.query for r in retrieve.asked_now(df, sources).collect()}
    assert now == {"a": "이영희 2월 3주차 회의록", "b": "3주차도 보여줘"}


def test_keyword_search_finds_dates_and_synonyms(spark):
    chunks = chunk_rows(spark, [
        {"chunk_id": "meeting", "page_id": "meeting", "title": "0526 주간회의", "breadcrumb": "기술연구소 > 26년 주간 기술회의 > 0526 주간회의", "page_content": "기술백서 리뷰"},
        {"chunk_id": "policy", "page_id": "policy", "title": "2026 전사 전결 규정", "breadcrumb": "SAMPLE TEAM SPACE > 전사", "page_content": "근태관리 팀장 결재"}])
    q = questions(spark, "26년 5월 26일자로 기술회의록 알려줘", "사내 전결 규정 알려줘")
    terms = keyword.query_terms(q, NOW)
    months = q.select("query_id", korean.requested_months(F.col("query")).alias("months"))
    top = {r.query_id: r.chunk_id for r in keyword.search(chunks, terms, NOW, months).filter("rank = 1").collect()}
    assert top == {"0": "meeting", "1": "policy"}


term_filter = matching.term_filter


def full_filter(terms):
    real = term_filter(terms)
    return matching.TermFilter(real.log_bits, np.full_like(real.bits, 255), real.lengths)


def test_matching_agrees_with_brute_force(spark, monkeypatch):
    texts = [("1", "abcabc the cat"), ("2", "the"), ("3", "xx"), ("4", "thecat abca"), ("5", None), ("6", ""), ("7", "회의록 회의" * 9)]
    words = ["abc", "th", "the", "cat", "a", "thecat", "zz", "bcab", "회의", "록 회", "x" * 70, "", None]
    t = spark.createDataFrame(texts, "chunk_id string, text string")
    w = spark.createDataFrame([(x,) for x in words], "term string")
    expected = {(k, x) for k, v in texts for x in words if x and x in (v or "")}
    # a full filter lets every window through, and the pairs stay the same
    for full, block in ((False, 1 << 20), (True, 4)):
        monkeypatch.setattr(matching, "term_filter", full_filter if full else term_filter)
        monkeypatch.setattr(matching, "BLOCK", block)
        got = matching.match_terms(t, w, "chunk_id").collect()
        assert len(got) == len(expected) and {(r.chunk_id, r.term) for r in got} == expected
    assert matching.match_terms(t, w.filter("false"), "chunk_id").count() == 0


def test_field_counts_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab회") for _ in range(rng.randrange(n)))
    rows = [(str(i), "p", word(6), word(8), word(60), []) for i in range(60)] + [("x", None, "aaaa", "aaa", "aaaaaaa", [3])]
    texts = spark.createDataFrame(rows, "chunk_id string, page_id string, title string, keyword string, content string, months array<int>")
    texts = texts.withColumn("gate", F.concat("title", F.lit("a"), "content"))
    terms = ["a", "aa", "ab", "회", "aba", "b회a", "aaaa", "zz"]
    for filter_ in (term_filter, full_filter):
        monkeypatch.setattr(keyword, "term_filter", filter_)
        found = {(r.chunk_id, f.term): f for r in keyword.scan_chunks(texts, spark.createDataFrame([(x,) for x in terms], "term string")).collect() for f in r.facts}
        for key, _, title, words, content, _ in rows:
            for t in terms:
                gate, head = title + "a" + content, title + words
                want = (t in gate, t in head, title.count(t), words.count(t), content.count(t))
                got = found.get((key, t))
                assert (tuple(got)[1:] if got else (False, False, 0, 0, 0)) == want, (key, t)


def test_vector_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    data = {f"c{i:03d}": rng.normal(size=8) for i in range(200)}
    asked = {f"q{i}": rng.normal(size=8) for i in range(5)}
    make = lambda d, n: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in d.items()], f"{n} string, embedding array<double>")
    unit = lambda v: v / np.linalg.norm(v)
    odd = [("null", None), ("hole", [1.0, None] + [0.0] * 6), ("short", [1.0])]
    chunks = make(data, "chunk_id").union(spark.createDataFrame(odd, "chunk_id string, embedding array<double>"))
    for size in (vector.BLOCK_BYTES, 200):
        got = vector.nearest(chunks, make(asked, "query_id"), 4, block_bytes=size).collect()
        for q, v in asked.items():
            best = sorted(data, key=lambda k: -float(unit(data[k]) @ unit(v)))[:4]
            assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.dimension_guard(make(data, "chunk_id"), 4096).collect()


def test_fusion_values(spark):
    lists = spark.createDataFrame([
        ("0", "vector", 1, "v", "내용 문서", None, None), ("0", "vector", 2, "s", "샘플보험 점검", None, None),
        ("0", "keyword", 1, "s", "샘플보험 점검", 10.0, 1.0), ("0", "keyword", 2, "k", "점검 문서", 5.0, 0.5)],
        "query_id string, list string, rank int, chunk_id string, title string, bm25_score double, title_match_score double")
    got = fusion.fuse(lists, keyword.query_terms(questions(spark, "샘플보험 점검"), NOW)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["s", "v", "k"]
    assert [round(r.final_score, 6) for r in got] == [0.8, 0.4, 0.3]


def test_scopes_and_issue_tables(spark):
    am = {"page_id": "AM-180", "source_type": "jira", "space": "AM", "space_name": "SAMPLE_MAINTENANCE", "content_type": "jira_issue", "issue_key": "AM-180",
          "title": "AM-180 26-04 샘플보험 정기점검", "issue_status": "DONE", "issue_status_category": "done", "assignee": "홍길동", "due_date": "2026-04-21"}
    chunks = chunk_rows(spark, [
        {**am, "chunk_id": "1", "page_content": "Title: 26-04 샘플보험 정기점검\nStatus: DONE"}, {**am, "chunk_id": "2", "page_content": "점검 결과"},
        {"chunk_id": "3", "source_type": "jira", "content_type": "jira_issue", "space": "DEMOAPP", "space_name": "DEMOAPP", "issue_key": "DEMOAPP-131",
         "issue_status_category": "in_progress", "page_content": "DEMOAPP 진행중 이슈"}])
    q = questions(spark, "4월 점검 완료 목록 알려줘", "DEMOAPP 프로젝트에서 현재 진행중인 이슈가 뭐야?")
    scopes = spark.createDataFrame([("0", "AM")], "query_id string, space string")
    asked = issue_summary.requests(scopes, q)
    doc = issue_summary.summary_documents(issue_summary.issue_rows(asked, chunks), asked, q).first()
    assert doc.page_content.count("| AM-180 |") == 1 and doc.issue_count == 1
    assert [r.space for r in scope.infer_scopes(q, chunks).filter("query_id = '1'").collect()] == ["DEMOAPP"]


def test_space_mention_ranking(spark):
    chunks = chunk_rows(spark, [
        {"chunk_id": "first", "source_type": "confluence", "space": "TEAM", "title": "AT Team 온보딩 문서", "page_content": "사내 내부 회사 안내", "chunk_index": 0},
        {"chunk_id": "target", "source_type": "confluence", "space": "TEAM", "title": "2026 전사 전결 규정", "page_content": "근태관리 팀장 결재", "chunk_index": 0}])
    q = questions(spark, "@AT_TEAM_SPACE 사내 전결 규정 알려줘")
    mentions = spark.createDataFrame([("0", 0, "space", "confluence", "TEAM", None)],
                                     "query_id string, mention_no int, mention_type string, source_type string, space string, page_id string")
    got = mention_context.mention_context(mentions, q, keyword.query_terms(q, NOW), chunks)
    assert got.orderBy("rank").first().chunk_id == "target"


def test_long_document_window(spark):
    rows = [("0", i + 1, str(i), "long", None, "long", None, i, f"chunk {i} " + ("TPS 130" if i == 12 else "noise")) for i in range(25)]
    docs = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, page_id string, url string, title string, breadcrumb string, chunk_index int, page_content string")
    q = questions(spark, "SAMPLE_APP V2 성능지표 문서에서 TPS 값 알려줘").withColumns(
        {"route": F.lit("long_doc_lookup"), "long_doc_neighbor_window": F.lit(4), "long_doc_detail_chunks": F.lit(48)})
    got = context.select_long_documents(docs, q).orderBy("rank").collect()
    assert [int(r.chunk_id) for r in got] == list(range(8, 17)) and got[0].long_document_mode == "lookup"
    scores = context.long_document_scores(docs.filter("chunk_index < 18"), q)
    assert [r.chunks for r in context.summary_windows(scores, 5, block=4).orderBy("window_no").collect()] == [5, 5, 5, 3]


def test_case_scores(spark):
    cases = spark.createDataFrame([("1",), ("2",)], "case_id string")
    ranks = spark.createDataFrame([("1", 1, "noise"), ("1", 2, "weekly-3"), ("1", 3, "weekly-4"), ("2", 1, "useful"), ("2", 2, "noise"), ("2", 3, "best")],
                                  "case_id string, rank int, page string")
    rel = spark.createDataFrame([("1", "weekly-3", None), ("1", "weekly-4", None), ("2", "best", 3), ("2", "useful", 2)], "case_id string, page string, grade int")
    bad = spark.createDataFrame([("1", "noise")], "case_id string, page string")
    got = {r.case_id: r for r in evaluation.score_cases(cases, ranks, rel, bad, 3).collect()}
    one = got["1"]
    assert (one.hit_at_k, one.recall_at_k, round(one.precision_at_k, 4), one.reciprocal_rank, one.has_forbidden_scope) == (1.0, 1.0, 0.6667, 0.5, True)
    assert round(got["2"].ndcg_at_k, 4) == 0.8212


def test_two_key_dedupe_and_facts(spark):
    page = lambda p, t: evaluation.ranked_page(F.lit(p), F.lit(t))
    row = spark.range(1).select(
        evaluation.dedupe_on_two_keys(F.array(page("page-1", "First"), page("page-1", "First duplicate"), page("", "Title only"), page("", "Title only"))).alias("p"),
        *evaluation.fact_score(F.lit("AM-174 샘플보험 2026-04-21 완료"), F.array(F.lit("AM-174"), F.lit("샘플보험"), F.lit("2026-04-21")))).first()
    assert [p.page_id for p in row.p] == ["page-1", ""] and row.fact_score == 1.0 and row.missing_facts == []


def test_snapshot_replace_and_failed_write(spark, tmp_path):
    table = str(tmp_path / "chunks")
    rows = spark.createDataFrame([("1", "wiki", "TEAM"), ("2", "wiki", "LAB")], "chunk_id string, source_type string, space string")
    snapshot.replace_source(rows, table, "run1")
    snapshot.replace_source(rows.filter("space = 'TEAM'").withColumn("chunk_id", F.lit("9")), table, "run2")
    read = lambda: sorted((r.chunk_id, r.space, r.ingest_run_id) for r in snapshot.read_table(spark, table).collect())
    assert read() == [("2", "LAB", "run1"), ("9", "TEAM", "run2")]
    with pytest.raises(Exception):
        snapshot.replace_source(rows.withColumn("chunk_id", F.raise_error(F.lit("boom")).cast("string")), table, "run3")
    assert read() == [("2", "LAB", "run1"), ("9", "TEAM", "run2")]


def test_landed_files(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text('﻿{"route": "exact_lookup", "total_seconds": 4.2, "prompt_chunks": 5, "timestamp": "2026-05-01T10:00:00"}\n\n', encoding="utf-8")
    row = route_statistics(landed.query_log(spark, str(log))).first()
    assert (row.route, row.records, row.avg_seconds) == ("exact_lookup", 1, 4.2)
    cases = tmp_path / "cases.jsonl"
    cases.write_text('{"id": "1", "relevant_pages": ["p"]}\n\n{"id": "2", "query": "x"}\n')
    with pytest.raises(Exception, match="golden case line 3"):
        landed.golden_cases(spark, str(cases)).collect()


def test_stream_grows_with_new_files(spark, tmp_path):
    log, table, mark = tmp_path / "log", str(tmp_path / "daily"), str(tmp_path / "mark")
    log.mkdir()
    line = '{"route": "%s", "total_seconds": %s, "prompt_chunks": 2, "timestamp": "2026-05-0%sT10:00:00"}\n'
    for n, lines in enumerate(([("a", 1.0, 1), ("b", 3.0, 1)], [("a", 3.0, 1), ("a", 5.0, 2)])):
        (log / f"{n}.jsonl").write_text("".join(line % x for x in lines))
        records = landed.query_log_stream(spark, str(log)).withColumn("timestamp", F.to_timestamp("timestamp"))
        log_statistics.run_once(log_statistics.daily_routes(records), table, mark)
    got = {(str(r.day), r.route): (r.records, r.avg_seconds) for r in spark.read.parquet(table).collect()}
    assert got == {("2026-05-01", "a"): (2, 2.0), ("2026-05-01", "b"): (1, 3.0), ("2026-05-02", "a"): (1, 5.0)}


def test_packing_by_blocks_equals_a_running_sum(spark):
    rng = random.Random(5)
    rows = [(q, rank, f"{q}:{rank}", None if rng.random() < 0.1 else "x" * rng.randrange(30)) for q in ("a", "b", "c") for rank in range(1, 40 if q < "c" else 2)]
    rng.shuffle(rows)
    texts = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, page_content string").repartition(3)
    docs = texts.withColumn("n_chars", F.length("page_content")).drop("page_content")

    def expected(budget, most=1000):
        out, used = set(), {}
        for q, rank, _, text in sorted(rows, key=lambda r: r[:2]):
            if used.get(q, 0) < budget and rank <= most:
                out.add((q, rank, None if text is None else text[:budget - used.get(q, 0)]))
            used[q] = used.get(q, 0) + len(text or "")
        return out

    def found(df, *more):
        return {tuple(r) for r in df.select(*more, "query_id", "rank", "packed").collect()}

    for block in (1, 3, 256):
        kept = context.within_budget(docs, F.lit(100), ["query_id"], block)
        assert {(r.query_id, r.rank) for r in kept.collect()} == {e[:2] for e in expected(100)}
    assert found(context.pack(docs, texts, F.lit(100))) == expected(100)
    assert found(context.pack(docs.drop("chunk_id"), texts, F.lit(0), ["query_id", "rank"])) == set()
    assert found(context.pack(docs.drop("chunk_id"), texts, F.lit(77), ["query_id", "rank"])) == expected(77)
    assert found(context.pack_budgets(docs, texts, [10, 50, 400]), "budget") == {(b, *e) for b in (10, 50, 400) for e in expected(b)}
    assert found(context.pack_first(docs, texts, [2, 7], 60), "chunk_count") == {(n, *e) for n in (2, 7) for e in expected(60, n)}
