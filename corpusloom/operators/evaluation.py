"""Retrieval quality: per-case scores, summaries, comparisons and answer checks.

Rankings are rows (case_id, rank, page); relevance rows are (case_id, page, grade), forbidden rows (case_id, page).
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import blank_to_null, let, normalize_any_script

METRICS = ["hit_at_k", "recall_at_k", "precision_at_k", "mrr", "ndcg_at_k"]
# fixed values: labels of the checked metrics
TARGET_LABELS = {
    "hit_at_k": "Hit@K", "recall_at_k": "Recall@K", "precision_at_k": "Precision@K", "mrr": "MRR",
    "ndcg_at_k": "nDCG@K", "forbidden_scope_rate": "Forbidden scope",
}


def gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1)


def ideal_gain(grades: DataFrame, k: int) -> DataFrame:
    """Best reachable gain at k per case: grades are counted per value, so a case of any size stays small."""
    per_value = grades.groupBy("case_id", "grade").agg(F.count("*").alias("n"))
    values = F.reverse(F.array_sort(F.collect_list(F.struct("grade", "n"))))
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0.0).alias("gain"))

    # prefix sums of the discounts turn a run of equal grades into one product
    discounts = [0.0]
    for rank in range(1, k + 1):
        discounts.append(discounts[-1] + 1 / math.log2(rank + 1))
    prefix = F.array(*[F.lit(d) for d in discounts])

    def add(state, value):
        upto = F.least(state["taken"] + value["n"], F.lit(k))
        part = F.get(prefix, upto.cast("int")) - F.get(prefix, state["taken"].cast("int"))
        return F.struct(upto.alias("taken"), (state["gain"] + value["grade"] * part).alias("gain"))

    return per_value.groupBy("case_id").agg(values.alias("v")).select(
        "case_id", F.aggregate("v", start, add)["gain"].alias("ideal"))


def score_cases(cases: DataFrame, rankings: DataFrame, relevance: DataFrame, forbidden: DataFrame, k: int = 5) -> DataFrame:
    """All per-case metrics in one aggregation over the judged ranks.

    ``relevance`` may hold explicit relevant pages (grade null) or graded pages; grades above 0 count as relevant
    when a case lists no pages, and listed pages count as grade 1 when it has no grades.
    """
    listed = F.col("grade").isNull()
    per_page = relevance.groupBy("case_id", "page").agg(F.max(listed).alias("listed"), F.max("grade").alias("grade"))
    kind = per_page.groupBy("case_id").agg(F.max("listed").alias("any_listed"), F.max(F.col("grade").isNotNull()).alias("any_grade"))
    judged = per_page.join(kind, "case_id").select(
        "case_id", "page",
        F.when(F.col("any_listed"), F.col("listed")).otherwise(F.col("grade") > 0).alias("relevant"),
        F.when(F.col("any_grade"), F.coalesce("grade", F.lit(0))).otherwise(1).cast("double").alias("grade"))
    counts = judged.groupBy("case_id").agg(F.count_if("relevant").alias("relevant_count"))
    banned = forbidden.select("case_id", "page").distinct().withColumn("banned", F.lit(True))

    seen = rankings.join(judged, ["case_id", "page"], "left").join(banned, ["case_id", "page"], "left")
    good = F.coalesce("relevant", F.lit(False))
    top = F.col("rank") <= k
    found = F.count_distinct(F.when(good & top, F.col("page")))
    bad = F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("banned") & top, F.struct("rank", "page")))), lambda x: x["page"]))
    scores = seen.groupBy("case_id").agg(
        found.alias("found"), F.min(F.when(good, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(top, gain(F.coalesce("grade", F.lit(0.0)), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        bad.alias("forbidden_pages"))
    out = cases.join(scores, "case_id", "left").join(counts, "case_id", "left").join(ideal_gain(judged, k), "case_id", "left")
    zero = F.lit(0.0)
    n = F.coalesce("found", F.lit(0))
    return out.select(
        *cases.columns, F.coalesce("relevant_count", F.lit(0)).alias("relevant_count"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("hit_at_k"),
        F.coalesce(F.try_divide(n, F.col("relevant_count")), zero).alias("recall_at_k"),
        (n / F.lit(k)).alias("precision_at_k") if k > 0 else zero.alias("precision_at_k"),
        F.coalesce(1 / F.col("first_hit"), zero).alias("reciprocal_rank"),
        F.coalesce(F.try_divide(F.col("dcg"), F.col("ideal")), zero).alias("ndcg_at_k"),
        F.coalesce("forbidden_pages", F.array().cast("array<string>")).alias("forbidden_pages"),
    ).withColumn("has_forbidden_scope", F.size("forbidden_pages") > 0)


def _means() -> list[Column]:
    def mean(name, alias=None):
        value = F.col(name).cast("double")
        return F.coalesce(F.avg(F.coalesce(value, F.lit(0.0))), F.lit(0.0)).alias(alias or name)

    return [
        F.count("*").alias("case_count"), mean("hit_at_k"), mean("recall_at_k"), mean("precision_at_k"),
        mean("reciprocal_rank", "mrr"), mean("ndcg_at_k"), mean("has_forbidden_scope", "forbidden_scope_rate"),
        mean("latency_ms", "average_latency_ms"),
    ]


def _with_latency(scores: DataFrame) -> DataFrame:
    return scores if "latency_ms" in scores.columns else scores.withColumn("latency_ms", F.lit(0.0))


def summarise(scores: DataFrame) -> DataFrame:
    return _with_latency(scores).agg(*_means())


def summarise_by_category(scores: DataFrame) -> DataFrame:
    """Overall row (level 1) and one row per category (level 0), in one rollup."""
    rows = _with_latency(scores).withColumn("category", F.coalesce("category", F.lit("")))
    return rows.rollup("category").agg(F.grouping("category").cast("int").alias("level"), *_means())


def compare_with_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, current, baseline, delta) rows of two summaries."""
    def tall(df, name):
        return df.select(*METRICS).unpivot([], METRICS, "metric", name)

    return tall(current, "current").join(tall(baseline, "baseline"), "metric").withColumn(
        "delta", F.col("current") - F.col("baseline"))


def target_rows(summary: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, label, value, target) of the checked metrics. ``targets``: metric, target."""
    names = list(TARGET_LABELS)
    labels = F.create_map(*[F.lit(x) for pair in TARGET_LABELS.items() for x in pair])
    rows = summary.select(*names).unpivot([], names, "metric", "value").withColumn("label", labels[F.col("metric")])
    return rows.join(targets.select("metric", "target"), "metric", "left").select("metric", "label", "value", "target")


def ranked_page(page_id: Column, title: Column) -> Column:
    """Page struct with the title falling back to the id."""
    pid = F.coalesce(page_id, F.lit(""))
    return F.struct(pid.alias("page_id"), F.coalesce(blank_to_null(title), pid).alias("title"))


def dedupe_on_two_keys(pages: Column) -> Column:
    """Keep a page only if neither its id nor its title was kept before; dropped pages mark nothing."""
    start = F.array().cast("array<struct<page_id: string, title: string>>")

    def add(kept, page):
        seen = F.exists(kept, lambda x: ((x["page_id"] != "") & (x["page_id"] == page["page_id"]))
                        | ((x["title"] != "") & (x["title"] == page["title"])))
        empty = (page["page_id"] == "") & (page["title"] == "")
        return F.when(seen | empty, kept).otherwise(F.concat(kept, F.array(page)))

    return F.aggregate(pages, start, add)


def fact_score(answer: Column, facts: Column) -> list[Column]:
    """Share of facts found in the answer, and the missing ones; 1.0 without facts."""
    missing = let(normalize_any_script(answer),
                  lambda text: F.filter(facts, lambda f: ~F.contains(text, normalize_any_script(f))))
    total = F.coalesce(F.size(facts), F.lit(0))
    score = F.when(total <= 0, 1.0).otherwise(F.try_divide(total - F.size(missing), total))
    none = F.array().cast("array<string>")
    return [score.alias("fact_score"), F.when(total <= 0, none).otherwise(missing).alias("missing_facts"), (score >= 0.8).alias("passed")]


def source_score(sources: Column, relevant: Column) -> Column:
    """Share of relevant pages among the source ids and titles; 1.0 without relevant pages."""
    ids = F.transform(sources, lambda s: F.coalesce(blank_to_null(s["page_id"]), blank_to_null(s["title"]), F.lit("")))
    keys = F.concat(ids, F.transform(sources, lambda s: F.coalesce(s["title"], F.lit(""))))
    total = F.coalesce(F.size(relevant), F.lit(0))
    hits = let(keys, lambda known: F.size(F.filter(relevant, lambda p: F.array_contains(known, p))))
    return F.when(total <= 0, 1.0).otherwise(F.try_divide(hits, total)).alias("source_score")


def estimated_tokens(chars: Column) -> Column:
    return F.ceil(chars / 3)


def prompt_statistics(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks, characters with separators, estimated tokens and distinct pages of packed prompts."""
    page = F.coalesce(*[blank_to_null(F.col(c)) for c in ("page_id", "title", "url")])
    gap = len(fv.CONTEXT_SEPARATOR)
    out = packed.groupBy(*keys).agg(
        F.count("*").alias("prompt_chunk_count"),
        (F.sum(F.length("packed")) + gap * (F.count("*") - 1)).alias("prompt_context_chars"),
        F.count_distinct(page).alias("prompt_unique_pages"))
    return out.withColumn("prompt_context_est_tokens", estimated_tokens(F.col("prompt_context_chars")))


# fixed values: result column and its average in the sweep summary
SWEEP_AVERAGES = {
    "fact_score": "answer_accuracy", "source_score": "source_accuracy", "passed": "pass_rate",
    "latency_seconds": "average_latency_seconds", "prompt_chunk_count": "average_prompt_chunks",
    "prompt_context_chars": "average_prompt_chars", "prompt_context_est_tokens": "average_prompt_est_tokens",
    "answer_chars": "average_answer_chars", "answer_est_tokens": "average_answer_est_tokens",
}


def sweep_summary(results: DataFrame) -> DataFrame:
    """Averages per axis value; absent values count as 0."""
    means = [F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(a) for c, a in SWEEP_AVERAGES.items()]
    return results.groupBy("axis_value").agg(F.count("*").alias("case_count"), *means)


def pearson(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Correlation over the pairs that are not both 0; null below two pairs or without variance."""
    a = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    b = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    pairs = rows.select(*(keys or []), a.alias("_x"), b.alias("_y")).filter((F.col("_x") != 0) | (F.col("_y") != 0))
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    value = F.when(F.count("*") >= 2, F.try_divide(F.covar_pop("_x", "_y"), spread))
    aggs = [F.count("*").alias("pairs"), value.alias("r")]
    return pairs.groupBy(*keys).agg(*aggs) if keys else pairs.agg(*aggs)
