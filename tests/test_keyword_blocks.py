"""Keyword gates and scores: no pair is a row before it is a result, and copies, months and repeated terms count as they did."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import normalize, normalize_long
from corpusloom.operators import keyword, keyword_blocks

CHUNK = "chunk_id string, page_id string, title string, keyword string, content string, months array<int>"


def prepared(spark, rows, asked, months=None):
    texts = spark.createDataFrame(rows, CHUNK).withColumn("gate", F.concat("title", F.lit(" "), "content"))
    terms = spark.createDataFrame(asked, "query_id string, term string, is_exact boolean, is_broad boolean")
    return keyword.prepare(texts, terms, months and spark.createDataFrame(months, "query_id string, months array<int>"), 2026)


def expected(rows, asked, months):
    """{(query, chunk): [(field score, title score, month)]} by the rules, pair by pair."""
    months, out, pairs, sizes = dict(months), {}, {}, {}
    facts = [(r[0], {f: r[i] for f, i in (("title", 2), ("keyword", 3), ("content", 4))}, r[2] + " " + r[4], r[2] + r[3], set(r[5])) for r in rows]
    for q in sorted({a[0] for a in asked} | set(months)):
        mine = [a for a in asked if a[0] == q]
        exact, broad, wanted = [a[1] for a in mine if a[2]], [a[1] for a in mine if a[3]], set(months.get(q, []))

        def gate(chunk):
            copies = [x for x in facts if x[0] == chunk]
            inside = lambda ts: any(t in x[2] for t in ts for x in copies)
            if exact:
                return inside(exact) and (not broad or inside(broad))
            return any(wanted & x[4] for x in copies) if wanted else True

        some = [x for x in facts if gate(x[0])]
        if exact or wanted:
            pairs[q] = {x[0] for x in some}
        n, mean = len(some), {f: sum(max(1, len(x[1][f])) for x in some) / max(1, len(some)) for f in keyword.FIELDS}
        sizes[q] = (n, *(round(mean[f], 6) for f in keyword.FIELDS))
        df = {(t, f): sum(a[1] == t for a in mine if exact or wanted for x in some if t in x[1][f]) or sum(t in x[1][f] for x in some) for t in {a[1] for a in mine} for f in keyword.FIELDS}
        for chunk in {x[0] for x in some}:
            copies, bm25, title, head = [x for x in some if x[0] == chunk], 0.0, 0, False
            for _, t, is_exact, _ in mine:
                for x in copies:
                    for f, w in keyword.FIELDS.items():
                        tf = x[1][f].count(t)
                        idf = max(fv.IDF_FLOOR, (n - df[t, f] + .5) / (df[t, f] + .5))
                        bm25 += w * idf * tf * (fv.BM25_K1 + 1) / (tf + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * max(1, len(x[1][f])) / mean[f]))
                    title, head = title + (t in x[1]["title"]), head or (is_exact and t in x[3])
            for x in copies if exact or wanted else copies[:1]:
                hit = bool(wanted & x[4])
                score, named = bm25 + 2 * hit, 1.0 if head else title / len(mine) if mine else 0.0
                if score > 0 or named > 0:
                    out.setdefault((q, chunk), []).append((round(score, 6), round(named, 6), hit))
    return out, pairs, sizes


@pytest.mark.parametrize("size", [4, 1024])
def test_scores_agree_with_every_pair(spark, monkeypatch, size):
    monkeypatch.setattr(keyword_blocks, "CHUNKS", size)
    monkeypatch.setattr(keyword_blocks, "QUERIES", 3)
    monkeypatch.setattr(keyword_blocks, "HELD", 2)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["ab", "abc", "회의", "dd", "e", "fgh"]) for _ in range(rng.randrange(n)))
    rows = [(f"c{i:02d}", f"p{i % 9}", text(3), text(3), text(9), rng.sample(range(1, 13), rng.randrange(3))) for i in range(50)]
    rows += [rows[3], rows[3], ("c07", "other", "ab", "dd", "abc fgh", [2])]
    words = ["ab", "abc", "회의", "dd", "fgh", "zz"]
    asked = [(f"q{q}", w, exact, not exact) for q in range(10) for w in rng.sample(words, 3) for exact in [q % 3 == 0 and rng.random() < .6]]
    asked += [a for a in asked if a[0] in ("q1", "q3")]
    months = [("q2", [2, 3]), ("q3", [5]), ("m1", [1]), ("q1", [])]
    pairs_of, gates, sizes = expected(rows, asked, months)
    p = prepared(spark, rows, asked, months)
    got = {}
    for r in keyword.field_scores(p).collect():
        got.setdefault((r.query_id, r.chunk_id), []).append((round(r.bm25_score, 6), round(r.title_match_score, 6), r.month_match))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in pairs_of.items()}
    found = [tuple(r) for r in keyword.gated_chunks(p).collect()]
    assert len(found) == len(set(found)) and set(found) == {(q, c) for q, cs in gates.items() for c in cs}
    stats = {r.query_id: (r.n, *(round(r[f"avg_len_{f}"], 6) for f in keyword.FIELDS)) for r in keyword.candidate_stats(p).collect()}
    assert stats == {q: s for q, s in sizes.items() if s[0]}
    # without copies and repeated terms, the k best pages are the first of all pairs
    p = prepared(spark, rows[:50], sorted(set(asked)), months)
    ranked = [keyword.rank_pages(s, k=3).select("query_id", "rank", "chunk_id", F.round("total", 6).alias("total")).collect() for s in (keyword.field_scores(p), keyword.page_scores(p, 3))]
    assert sorted(ranked[0]) == sorted(ranked[1]) and len(ranked[0]) > 20


def test_pairs_and_facts_are_not_shuffled(spark):
    p = prepared(spark, [("c", "p", "ab", "ab", "ab cd", [1])], [("q", "ab", True, False), ("r", "cd", False, True)])
    for found in (keyword.field_scores(p), keyword.page_scores(p, 3), keyword.gated_chunks(p)):
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_normalised_alike(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aZz09 _-\n.\t\x00\x1fé가힣힤ㄱ😀İKßẞ회") for _ in range(rng.randrange(30))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *map(ascii, texts), "", None, bytes(range(1, 128)).decode()]], "t string")
    assert rows.filter(~normalize(F.col("t")).eqNullSafe(normalize_long(F.col("t")))).count() == 0
