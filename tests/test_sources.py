"""Landed issues, log retention and statistics of late days."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import issues
from corpusloom.sources import landed, log_sink
from corpusloom.streaming import log_statistics


def _text(*words):
    return {"type": "paragraph", "content": [{"type": "text", "text": w} for w in words]}


def test_landed_issues_keep_raw_values_and_plain_bodies(spark, tmp_path):
    fields = {"summary": "s", "status": {"name": "Done", "statusCategory": {"key": "done"}}, "updated": "2026-05-01",
              "description": {"type": "doc", "content": [_text("first"), _text("second")]},
              "comment": {"comments": [{"author": {"displayName": "A"}, "created": "2026-05-02", "body": {"type": "doc", "content": [_text("said")]}},
                                       {"author": None, "created": None, "body": "plain words"}]},
              "customfield_1": "plain text, not JSON", "customfield_2": {"value": "picked"}, "customfield_3": "{broken", "customfield_4": "12", "customfield_5": None}
    lines = [json.dumps({"key": f"P-{i}", "fields": fields | {"updated": f"2026-05-{i % 28 + 1:02d}"}}) for i in range(1100)]
    (tmp_path / "issues.json").write_text("\n".join(lines))
    rows = landed.issues(spark, str(tmp_path / "issues.json"), "P")
    assert rows.count() == 1100 and landed.issues(spark, str(tmp_path / "issues.json"), "P", newest=7).count() == 7
    one = rows.filter("key = 'P-5'")
    names = spark.createDataFrame([("customfield_1", "One"), ("customfield_2", "Two")], "id string, name string")
    custom = issues.custom_fields(one, names)
    assert [(f.name, f.text) for f in custom.first().fields] == [("One", "plain text, not JSON"), ("Two", "picked"), ("customfield_3", "{broken"), ("customfield_4", "12")]
    full = issues.overview(one.join(custom, "key").withColumn("comments", F.col("raw_comments")))
    text = issues.issue_chunks(full).first().page_content
    assert "first second" in text and "- A at 2026-05-02: said" in text and "plain words" in text and '"type"' not in text


def test_retention_removes_day_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"2026-05-{d:02d}T00:00:00", "q") for d in range(1, 11)], "timestamp string, question string")
    folder = str(tmp_path / "log")
    assert log_sink.append(rows, folder)
    assert log_sink.drop_expired(spark, folder, "2026-05-10", 0) == []
    assert log_sink.drop_expired(spark, folder, "2026-05-10", 3) == [f"2026-05-{d:02d}" for d in range(1, 7)]
    assert log_sink.day_folders(spark, folder) == ["2026-05-07", "2026-05-08", "2026-05-09", "2026-05-10"]
    assert log_sink.expired_days(spark, str(tmp_path / "none"), "2026-05-10", 3) == []


def test_late_days_are_counted(spark, tmp_path):
    schema = "timestamp timestamp, route string, total_seconds double, prompt_chunks int"
    folder, table, state = str(tmp_path / "in"), str(tmp_path / "daily"), str(tmp_path / "state")
    for days in ((5, 6), (1,), (5, 1)):
        spark.createDataFrame([(f"2026-05-{d:02d} 10:00:00", "general", 2.0, d) for d in days], "timestamp string, route string, total_seconds double, prompt_chunks int").withColumn(
            "timestamp", F.col("timestamp").cast("timestamp")).write.mode("append").parquet(folder)
        log_statistics.run_once(log_statistics.daily_routes(spark.readStream.schema(schema).parquet(folder)), table, state)
    found = {(str(r.day), r.records, r.avg_prompt_chunks) for r in spark.read.parquet(table).collect()}
    assert found == {("2026-05-01", 2, 1.0), ("2026-05-05", 2, 5.0), ("2026-05-06", 1, 6.0)}


def test_rows_without_a_chunk_id_stay_apart(spark):
    from corpusloom.operators import fusion
    rows = [("0", "keyword", 1, "", "p", i, "u", "t", 1.0, 0.5) for i in range(3)] + [("0", "vector", 1, "", "p", 0, "u", "t", None, None), ("0", "vector", 2, "c", "p", 1, "u", "t", None, None)]
    lists = spark.createDataFrame(rows, "query_id string, list string, rank int, chunk_id string, page_id string, chunk_index int, url string, title string, bm25_score double, title_match_score double")
    assert fusion.merged(lists, ["query_id"]).count() == 4
    terms = spark.createDataFrame([("0", "t")], "query_id string, term string")
    assert fusion.fuse(lists, terms).count() == 4


def test_limits_above_the_built_in_ones_hold(spark):
    from corpusloom.plans.retrieve import bounds
    from corpusloom.functions import routing
    profiles = routing.profiles(spark).withColumn("keyword_top_k", F.lit(55))
    assert bounds(profiles)["keyword_top_k"] == 55


def test_replayed_log_batches_add_nothing(spark, tmp_path):
    schema = "timestamp string, question string"
    folder, state, landed_in = str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "in")
    rows = spark.createDataFrame([("2026-05-01T10:00:00", "a"), ("2026-05-02T10:00:00", "b")], schema)
    read = lambda: sorted((r.question, r.log_date) for r in log_sink.read_log(spark, folder, "question string").collect())
    assert read() == []
    # a first attempt that wrote one day and broke off before its ledger entry
    log_sink.append_once(rows.filter("question = 'a'"), folder, "s", "7")
    store, entry = log_sink._store(spark, log_sink._ledger(folder, "s", "7"))
    assert store.delete(entry, False) and read() == []
    for _ in range(3):
        log_sink.append_once(rows, folder, "s", "7")
        assert read() == [("a", "2026-05-01"), ("b", "2026-05-02")]
    log_sink.append_once(rows, folder, "s", "8")
    assert len(read()) == 4 and log_sink.day_folders(spark, folder) == ["2026-05-01", "2026-05-02"]
    broken = rows.withColumn("question", F.raise_error(F.lit("boom")).cast("string"))
    assert not log_sink.append(broken, folder, batch="9") and len(read()) == 4
    for n in range(2):
        rows.withColumn("question", F.lit(f"stream {n}")).write.mode("append").json(landed_in)
        for _ in range(2):
            log_sink.append_stream(spark.readStream.schema(schema).json(landed_in), folder, "live", state)
    assert len(read()) == 8


def test_published_runs(spark, tmp_path):
    from corpusloom.sources import snapshot
    table = str(tmp_path / "chunks")
    rows = spark.createDataFrame([("1", "wiki", "7"), ("2", "wiki", "LAB"), ("3", None, "LAB")], "chunk_id string, source_type string, space string")
    read = lambda df=None: sorted((r.chunk_id, r.space, r.ingest_run_id) for r in (df or snapshot.read_table(spark, table)).collect())
    snapshot.replace_source(rows, table, "run1")
    pinned = snapshot.read_table(spark, table)
    first = [("1", "7", "run1"), ("2", "LAB", "run1"), ("3", "LAB", "run1")]
    assert read() == first
    # rows that are written but not committed are not seen
    rows.withColumn("chunk_id", F.lit("half")).write.partitionBy("source_type", "space").parquet(f"{table}/data/ingest_run_id=run2")
    assert read() == first and snapshot.unread_runs(spark, table) == ["run2"]
    # a source whose new run is empty loses its old rows, others stay
    gone = spark.createDataFrame([("wiki", "7")], "source_type string, space string")
    snapshot.replace_source(rows.filter("chunk_id = '2'").withColumn("chunk_id", F.lit("9")), table, "run2", gone)
    assert read() == [("3", "LAB", "run1"), ("9", "LAB", "run2")]
    assert read(pinned) == first, "a reader keeps the snapshot it began with"
    snapshot.replace_source(rows.limit(0), table, "run3", gone)
    assert read() == [("3", "LAB", "run1"), ("9", "LAB", "run2")]
    snapshot.drop_run(spark, table, "run2")
    assert read() == [("2", "LAB", "run1"), ("3", "LAB", "run1")]
