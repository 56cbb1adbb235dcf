"""Korean question analysis: search terms, dates, weeks and months."""

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import normalize, normalized, of_distinct, rx_all, rx_groups


def strip_particle(term: Column) -> Column:
    """Drop one trailing particle, the first of the list that fits."""
    out = None
    for suffix in fv.PARTICLES:
        fits = F.endswith(term, F.lit(suffix)) & (F.length(term) > len(suffix) + 1)
        cut = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(term)


def synonym_map(synonyms: dict[str, list[str]] = fv.SYNONYMS) -> Column:
    entries = []
    for word, others in synonyms.items():
        entries += [F.lit(word), F.array(*[F.lit(o) for o in others])]
    return F.create_map(*entries)


def expand_synonyms(terms: Column, synonyms: Column | None = None) -> Column:
    """One hop through the synonym dictionary, all results normalised."""
    table = synonym_map() if synonyms is None else synonyms
    none = F.array().cast("array<string>")
    return F.transform(
        F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), none))), normalize
    )


def broad_terms(c: Column) -> Column:
    runs = F.transform(rx_all(c, fv.HANGUL_RUN), strip_particle)
    kept = F.filter(runs, lambda t: ~t.isin(fv.STOP_WORDS) & ~F.endswith(t, F.lit("주차")))
    minutes = F.transform(
        F.filter(kept, lambda t: F.endswith(t, F.lit("회의록"))),
        lambda t: F.substring(t, F.lit(1), F.length(t) - 1),
    )
    return F.array_sort(F.array_distinct(F.concat(kept, expand_synonyms(kept), minutes)))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _date_variants(year: Column, month: Column, day: Column) -> Column:
    mmdd = F.concat(_two(month), _two(day))
    yy = F.right(year, F.lit(2))
    return F.array(mmdd, F.concat(yy, mmdd), F.concat(F.lit("20"), yy, mmdd))


def _dates_of(found: Column, year=None) -> Column:
    def month(d):
        return d["m"].cast("int")

    def day(d):
        return d["d"].cast("int")

    valid = F.filter(found, lambda d: month(d).between(1, 12) & day(d).between(1, 31))
    return F.flatten(
        F.transform(valid, lambda d: _date_variants(d["y"] if year is None else F.lit(str(year)), month(d), day(d)))
    )


def calendar_date_terms(c: Column, now_year: int) -> Column:
    """Spellings of every calendar date named in the text."""
    compact = F.transform(
        F.filter(rx_groups(c, fv.DATE_COMPACT, ["m", "d"]), lambda d: d["d"].cast("int").between(1, 31)),
        lambda d: F.concat(d["m"], d["d"]),
    )
    return F.array_sort(F.array_distinct(F.concat(
        _dates_of(rx_groups(c, fv.DATE_KOREAN, ["y", "m", "d"])),
        _dates_of(rx_groups(c, fv.DATE_SEPARATED, ["y", "m", "d"])),
        _dates_of(rx_groups(c, fv.DATE_MONTH_DAY, ["m", "d"]), now_year),
        compact,
    )))


def _week_variants(yy: Column, month: Column, week: Column) -> list[Column]:
    mm, w, ww = _two(month), week.cast("string"), _two(week)
    dash = F.concat(yy, F.lit("-"), mm, F.lit("-"))
    return [
        F.concat(yy, mm, w, F.lit("주차")), F.concat(yy, mm, ww, F.lit("주차")), F.concat(yy, mm, w, F.lit("w")),
        F.concat(dash, w, F.lit("주차")), F.concat(dash, ww, F.lit("주차")), F.concat(dash, w, F.lit("w")),
    ]


def week_terms(c: Column, now_year: int) -> Column:
    """Spellings of every week-of-month named in the text."""
    this_year = F.lit(f"{now_year % 100:02d}")

    def of_full(d):
        return F.array(*_week_variants(F.right(d["y"], F.lit(2)), d["m"].cast("int"), d["w"].cast("int")))

    def of_month(d):
        month, week = d["m"].cast("int"), d["w"].cast("int")
        w = week.cast("string")
        plain = [F.concat(m, F.lit("월"), w, F.lit(end)) for m in (month.cast("string"), _two(month)) for end in ("주차", "w")]
        return F.array(*plain, *_week_variants(this_year, month, week))

    full = F.transform(rx_groups(c, fv.WEEK_FULL, ["y", "m", "w"]), of_full)
    month = F.transform(rx_groups(c, fv.WEEK_MONTH, ["m", "w"]), of_month)
    return F.array_sort(F.array_distinct(F.flatten(F.concat(full, month))))


def temporal_terms(c: Column, now_year: int) -> Column:
    return F.array_sort(F.array_distinct(F.concat(calendar_date_terms(c, now_year), week_terms(c, now_year))))


def exact_terms(c: Column, now_year: int) -> Column:
    """Issue keys and date or week spellings, normalised."""
    keys = F.transform(rx_all(c, "(?i)" + fv.ISSUE_KEY, 0), F.lower)
    every = F.transform(F.concat(keys, temporal_terms(c, now_year)), normalize)
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: t != "")))


def searchable(c: Column, now_year: int, plain: Column | None = None) -> Column:
    """Normalised text followed by the spellings of its own dates and weeks.

    Only text with a digit can hold a date, so the pattern work is skipped for the rest. ``plain`` is the normalised text, where
    it was made before.
    """
    own_dates = normalize(F.array_join(temporal_terms(c, now_year), " "))
    return F.concat(normalize(c) if plain is None else plain, F.when(c.rlike("[0-9]"), own_dates).otherwise(F.lit("")))


# characters whose classes and word edges are the same in Python's patterns and in Java's; texts with others take the column rules
_UNUSUAL = re.compile("[^\t\n\r -~À-ÿ가-힣]")
_DIGIT = re.compile("[0-9]")
_DATE_KOREAN, _DATE_SEPARATED, _DATE_MONTH_DAY, _DATE_COMPACT, _WEEK_FULL, _WEEK_MONTH = map(re.compile, (
    fv.DATE_KOREAN, fv.DATE_SEPARATED, fv.DATE_MONTH_DAY, fv.DATE_COMPACT, fv.WEEK_FULL, fv.WEEK_MONTH))
_LOCATOR_MONTHS = [re.compile(p) for p in (fv.LOCATOR_COMPACT, fv.LOCATOR_SEPARATED, fv.MONTH_WORD)]


def _temporal(text: str, now_year: int) -> set[str]:
    """``temporal_terms`` of a text without unusual characters."""
    out = {m + d for m, d in _DATE_COMPACT.findall(text) if 1 <= int(d) <= 31}
    dates = _DATE_SEPARATED.findall(text)
    weeks = [(y[-2:], int(m), int(w)) for y, m, w in _WEEK_FULL.findall(text)]
    if "월" in text:
        dates += [*_DATE_KOREAN.findall(text), *((str(now_year), m, d) for m, d in _DATE_MONTH_DAY.findall(text))]
        for m, w in _WEEK_MONTH.findall(text):
            month, week = int(m), int(w)
            weeks.append((f"{now_year % 100:02d}", month, week))
            out.update(f"{n}월{week}{end}" for n in (month, f"{month:02d}") for end in ("주차", "w"))
    for y, m, d in dates:
        month, day = int(m), int(d)
        if 1 <= month <= 12 and 1 <= day <= 31:
            mmdd = f"{month:02d}{day:02d}"
            out.update((mmdd, y[-2:] + mmdd, "20" + y[-2:] + mmdd))
    for yy, month, week in weeks:
        for start in (f"{yy}{month:02d}", f"{yy}-{month:02d}-"):
            out.update((f"{start}{week}주차", f"{start}{week:02d}주차", f"{start}{week}w"))
    return out


def _searched(text: str, now_year: int) -> str | None:
    if not _DIGIT.search(text):
        return normalized(text)
    if _UNUSUAL.search(text):
        return None
    return normalized(text) + normalized(" ".join(sorted(_temporal(text, now_year))))


def searchable_long(c: Column, now_year: int) -> Column:
    """``searchable`` of a text that is not null, read once; a text that repeats in a batch is worked on once."""
    def each(texts: pa.Array) -> pa.Array:
        return of_distinct(texts, lambda t: None if t is None else _searched(t, now_year), pa.string())

    return F.coalesce(F.arrow_udf(each, "string")(c), searchable(c, now_year))


def _located(text: str | None) -> list[int] | None:
    if text is None or not _DIGIT.search(text):
        return None if text is None else []
    if _UNUSUAL.search(text):
        return None
    return sorted({int(m) for p in _LOCATOR_MONTHS for m in p.findall(text)})


def locator_months_long(c: Column) -> Column:
    """``locator_months`` of a text that may be as long as its page."""
    def each(texts: pa.Array) -> pa.Array:
        return of_distinct(texts, _located, pa.list_(pa.int32()))

    return F.coalesce(F.arrow_udf(each, "array<int>")(c), locator_months(c))


def _months(c: Column, patterns: list[str]) -> Column:
    found = [F.transform(rx_all(c, p), lambda m: m.cast("int")) for p in patterns]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def requested_months(c: Column) -> Column:
    return _months(c, [fv.MONTH_WORD])


def requested_months_wide(c: Column) -> Column:
    """Also takes the yy-mm spelling."""
    return _months(c, [fv.MONTH_WORD, fv.YEAR_MONTH])


def locator_months(c: Column) -> Column:
    return _months(c, [fv.LOCATOR_COMPACT, fv.LOCATOR_SEPARATED, fv.MONTH_WORD])


def locator(title: Column, breadcrumb: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(breadcrumb, F.lit("")))


def month_sort_key(c: Column) -> Column:
    """Earliest (month, day) of a locator, (99, 99) when it holds no date."""
    found = F.concat(
        rx_groups(c, fv.LOCATOR_COMPACT_DAY, ["m", "d"]), rx_groups(c, fv.LOCATOR_SEPARATED_DAY, ["m", "d"])
    )
    days = F.transform(found, lambda d: F.struct(d["m"].cast("int").alias("m"), d["d"].cast("int").alias("d")))
    none = F.struct(F.lit(99).alias("m"), F.lit(99).alias("d"))
    return F.coalesce(F.array_min(days), none)
