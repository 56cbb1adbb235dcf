"""Anchors of a question and the rules that carry them from turn to turn."""

from pyspark.sql import Column, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import has_any, rx_all, rx_first, strip_spaces

ANCHORS = ["subject", "year", "month", "week", "document_type"]


def _first_subject(c: Column) -> Column:
    def allowed(name):
        return ~F.regexp_replace(name, "의$", "").isin(fv.SUBJECT_STOP_WORDS)

    return F.coalesce(*[F.get(F.filter(rx_all(c, p), allowed), F.lit(0)) for p in fv.SUBJECT_PATTERNS])


def _first_number(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[rx_first(c, p) for p in patterns]).cast("int").cast("string")


def anchors(c: Column) -> Column:
    kind = F.coalesce(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in fv.DOCUMENT_TYPES])
    return F.struct(
        _first_subject(c).alias("subject"),
        rx_first(c, fv.ANCHOR_YEAR).alias("year"),
        _first_number(c, fv.ANCHOR_MONTH).alias("month"),
        _first_number(c, fv.ANCHOR_WEEK).alias("week"),
        kind.alias("document_type"),
    )


def format_anchors(a: Column) -> Column:
    return F.concat_ws(
        " ", a["subject"], F.concat(a["year"], F.lit("년")), F.concat(a["month"], F.lit("월")),
        F.concat(a["week"], F.lit("주차")), a["document_type"],
    )


def is_standalone(a: Column) -> Column:
    period = a["year"].isNotNull() | a["month"].isNotNull() | a["week"].isNotNull()
    return a["document_type"].isNotNull() & a["subject"].isNotNull() & period


def any_anchor(a: Column) -> Column:
    return F.coalesce(*[a[f] for f in ANCHORS]).isNotNull()


def resolve(query: Column, current: Column, previous: Column) -> Column:
    """Struct (retrieval_query, scope_changed, anchors) of one question."""
    changed = F.lit(False)
    for f in ANCHORS:
        changed = changed | (current[f].isNotNull() & ~current[f].eqNullSafe(previous[f]))
    keep = F.contains(query, F.lit("@")) | is_standalone(current) | ~any_anchor(previous) | ~changed
    merged = F.struct(*[F.coalesce(current[f], previous[f]).alias(f) for f in ANCHORS])
    return F.struct(
        F.when(keep, query).otherwise(format_anchors(merged)).alias("retrieval_query"),
        (~keep).alias("scope_changed"),
        F.when(keep, current).otherwise(merged).alias("anchors"),
    )


def has_standalone_anchor(query: Column) -> Column:
    period = query.rlike("(?U)" + fv.STANDALONE_PERIOD)
    domain = has_any(strip_spaces(query), fv.STANDALONE_DOMAIN)
    return period | (domain & query.rlike(fv.STANDALONE_NAME))


def reuses_prior_sources(query: Column, has_mentions: Column) -> Column:
    flat = strip_spaces(query)
    short = F.length(F.regexp_replace(query, r"(?U)^\s+|\s+$", "")) <= fv.SHORT_QUESTION_CHARS
    fresh = short & ~has_standalone_anchor(query)
    return (
        F.when(has_mentions | query.rlike(r"(?U)" + fv.MENTION_TOKEN), F.lit(False))
        .when(has_any(flat, fv.REFERENCE_MARKERS + fv.EXPANSION_MARKERS), F.lit(True))
        .otherwise(fresh)
    )
