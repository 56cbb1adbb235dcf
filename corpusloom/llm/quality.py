"""Quality rules with thresholds that follow the corpus.

Each document gets four measures, whole numbers in thousandths so that every engine agrees on them: symbols per word, mean
word length, share of repeated lines, share of words in repeated three-word windows. Per language and source
each measure is summed up in a quantile sketch: counts per bucket, where a bucket
holds the values that agree in their leading four bits (values within about 6 % of each other). Sketches of parts merge by adding counts, in
any order, so a group's sketch comes from partial sums of all tasks, a hot source costs no more than another, and a retried
task changes nothing. To a group's counts those of its language are added, scaled to the weight of ``LENT`` documents, and to a
language's those of all: a small group leans on what is usual around it, a large one on itself, and no size switches between
them. Thresholds are fences around the middle half, ``q75 + reach * max(q75 - q25, least)``: they follow
what is usual in a group instead of removing a fixed share of it. A document beyond a fence of its group goes.

Only built-in functions are used. Measures are written once to the shared folder as narrow rows and read by both the
sketches and the verdict; the threshold table is written as well, so that the planner knows its size when it joins.

Defined results: a null text has no words and fails the base rules. Null languages and sources are groups like any other.
An empty table gives an empty result. Repeated rows are judged each. Other columns pass through ``clean`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.storage import stage

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules that hold for every group.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents that the coarser group's counts weigh in a group; counts are kept in so many parts of a document.
LENT, PARTS = 100, 100


@dataclass(frozen=True)
class Fence:
    """A measure's bounds: so many widths of the middle half above it (and below it); a width is ``least`` at least."""

    measure: str
    reach: int
    least: int
    below: bool = False


FENCES = (Fence("symbol_rate", 3, 50), Fence("word_length", 3, 500, below=True), Fence("line_rate", 3, 150), Fence("window_rate", 3, 150))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, chars: str, instead: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def _repeated_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more, by sorting the windows with their places."""
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

    def places(pairs: Column) -> Column:
        # beyond the ends there is no neighbour, and nothing equals it
        later = F.filter(pairs, lambda x, i: x["w"] == F.get(pairs, i - 1)["w"])
        earlier = F.filter(pairs, lambda x, i: x["w"] == F.get(pairs, i + 1)["w"])
        return _let(later, lambda found: F.when(F.size(found) == 0, 0).otherwise(F.size(F.array_distinct(F.flatten(
            F.transform(F.concat(found, earlier), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))))

    return F.coalesce(_let(F.sort_array(windows), places), F.lit(0))


def counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (long)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0)
    words = F.filter(F.split(_without(text, BLANKS[1:], " "), " "), lambda x: x != "")
    return _let(F.struct(words.alias("words"), lines.alias("lines")), lambda s: F.struct(
        F.size(s["words"]).cast("long").alias("n_words"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(s["lines"]) - F.size(F.array_distinct(s["lines"]))).cast("long").alias("n_dup_lines"),
        F.size(s["lines"]).cast("long").alias("n_lines"),
        _repeated_words(s["words"], F.size(s["words"])).cast("long").alias("n_repeat_words")))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("long")


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, lang, source, counts, measures, base_failed, more) of each document."""
    rows = docs.select("doc_id", "lang", "source", *more, counts(F.col("text")).alias("c"))
    rows = rows.select(*rows.columns[:-1], "c.*")
    n = F.col("n_words")
    return rows.withColumns({
        "symbol_rate": _rate(F.col("n_symbols"), n), "word_length": _rate(F.col("word_chars"), n),
        "line_rate": _rate(F.col("n_dup_lines"), F.col("n_lines")), "window_rate": _rate(F.col("n_repeat_words"), n),
        "base_failed": (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)})


def bucket(value: Column) -> Column:
    """The least value of a value's bucket: its leading four bits, the rest zero."""
    drop = F.greatest(F.length(F.bin(value)) - 4, F.lit(0))
    return F.when(value < 16, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop))


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, bucket, n): mergeable quantile sketches of all measures."""
    each = F.explode(F.array(*[F.struct(F.lit(f.measure).alias("measure"), bucket(F.col(f.measure)).alias("bucket")) for f in FENCES]))
    return rows.select(*by, each.alias("m")).groupBy(*by, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, size, q25, q75) of each sketch: a quantile is the bucket in which that share of the values is reached."""
    buckets = F.sort_array(F.collect_list(F.struct("bucket", "n")))  # bounded: a few buckets for each doubling of a value

    def at(share: float) -> Column:
        need = F.ceil(F.col("size") * share)
        walk = F.aggregate("buckets", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at")), lambda a, x: F.struct(
            (a["sum"] + x["n"]).alias("sum"), F.when(a["at"].isNull() & (a["sum"] + x["n"] >= need), x["bucket"]).otherwise(a["at"]).alias("at")))
        return walk["at"]

    return (sketch.groupBy(*by, "measure").agg(buckets.alias("buckets"), F.sum("n").alias("size"))
            .select(*by, "measure", "size", at(0.25).alias("q25"), at(0.75).alias("q75")))


def lent(own: DataFrame, above: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """Sketches of groups, and added to each the sketch of the coarser group it is part of, scaled to ``LENT`` documents."""
    size = F.sum("n").over(Window.partitionBy(*shared, "measure"))  # few rows: a few buckets for each doubling of a value
    share = above.withColumn("size_", size).select(*[F.col(c).alias(f"{c}_") for c in [*shared, "measure"]], "bucket", F.expr(f"n * {LENT * PARTS} div size_").alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*shared, "measure"]]
    added = own.select(*by, "measure").distinct().join(share, same).select(*by, "measure", "bucket", "n")
    return merged(own.select(*by, "measure", "bucket", "n").unionByName(added), by)


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>): fences of each group, with what coarser groups lend it."""
    sizes = sketches(rows, ["lang", "source"]).withColumn("n", F.col("n") * PARTS)
    fine = stage(sizes, "sketches")
    by_lang = merged(fine, ["lang"])
    lang = lent(by_lang, merged(by_lang, []), ["lang"], [])
    chosen = quartiles(lent(fine, lang, ["lang", "source"], ["lang"]), ["lang", "source"]).select("lang", "source", "measure", F.struct("q25", "q75").alias("u"))

    def high(f: Fence) -> Column:
        return F.col("u.q75") + f.reach * F.greatest(F.col("u.q75") - F.col("u.q25"), F.lit(f.least))

    def low(f: Fence) -> Column:
        return F.col("u.q25") - f.reach * F.greatest(F.col("u.q75") - F.col("u.q25"), F.lit(f.least)) if f.below else F.lit(None).cast("long")

    pick = lambda f, value: F.max(F.when(F.col("measure") == f.measure, value))
    return chosen.groupBy("lang", "source").agg(*[x for f in FENCES for x in (
        pick(f, low(f)).alias(f"low_{f.measure}"), pick(f, high(f)).alias(f"high_{f.measure}"))])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows with ``kept``: true for what passes the base rules and lies inside its group's fences.

    The join has no hint: a small threshold table is broadcast by its size, a large one meets the rows of a hot group in
    16 places by a salt.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    limits = limits.withColumns({"group_": F.struct(F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull()),
                                 "salt_": F.explode(F.sequence(F.lit(0), F.lit(15)))}).drop("lang", "source")
    group = F.struct(F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull())
    out = rows.withColumns({"group_": group, "salt_": salt}).join(limits, ["group_", "salt_"], "left").drop("group_", "salt_")
    inside = F.lit(True)
    for f in FENCES:
        inside &= F.col(f.measure) <= F.col(f"high_{f.measure}")
        if f.below:
            inside &= F.col(f.measure) >= F.col(f"low_{f.measure}")
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def verdicts(docs: DataFrame) -> DataFrame:
    rows = stage(measured(docs), "measures")
    return judged(rows, stage(thresholds(rows), "thresholds"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, as they are; they travel with their measures, so repeated ids are judged row by row."""
    rows = stage(measured(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("document")), "measures")
    return judged(rows, stage(thresholds(rows), "thresholds")).where("kept").select("document.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
