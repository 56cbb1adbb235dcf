"""Queries over small tables of their own, next to their SQL: every pair is returned."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import issues
from suite import ORACLES, QUERIES

SEGMENTS = ["BUILDING", "MACHINERY", "AUTOMOBILE"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2023, 1, 1)
    made = {
        "customer": ([(i, f"Customer {i}", SEGMENTS[i % 3]) for i in range(20)], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": ([(i, i % 20, "OFP"[i % 3], "1-URGENT", day + datetime.timedelta(days=i * 3 % 700)) for i in range(2000)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"),
        "documents": ([(i, f"title {i}\nalpha {'beta' if i % 2 else 'gamma delta'} {i % 7} " + "word " * (i % 5 * 90), "en", f"src{i % 2}") for i in range(120)] + [(120, "", "en", "src0")],
                      "doc_id long, text string, lang string, source string"),
        "benchmark": ([(i, "alpha gamma title" if i % 2 else "beta delta") for i in range(6)], "item_id long, text string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    con = duckdb.connect()
    for table in ("customer", "orders", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    result = con.execute(ORACLES[name])
    order = [[c[0] for c in result.description].index(c) for c in df.columns]
    return df, sorted(map(tuple, df.collect()), key=str), sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name, most", [("r21_mention_scores", 30), ("r22_month_narrowing", 50)])
def test_every_pair_of_a_question_is_kept(spark, tables, name, most):
    df, got, expected = both(spark, tables, name)
    assert got == expected
    assert df.groupBy("query_id").count().agg(F.max("count")).first()[0] > most


def test_every_matching_issue_chunk_is_a_row(spark, tables):
    df, got, expected = both(spark, tables, "r23_issue_match")
    assert got == expected and len({r[df.columns.index("chunk_id")] for r in got}) > 200


def test_custom_fields_keep_their_whole_text(spark):
    text = "word " * 300 + "end"
    rows = spark.createDataFrame([("a", {"customfield_1": f'{{"value":"{text}"}}', "customfield_2": f'"{text}"'})], "key string, custom map<string,string>")
    names = spark.createDataFrame([("customfield_1", "One"), ("customfield_2", "Two")], "id string, name string")
    assert [f.text for f in issues.custom_fields(rows, names).first().fields] == [text, text]
