"""Column expressions for text clean-up, term extraction and counting."""

import re
import string
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F

from corpusloom import fixed_values as fv


def rx_all(c: Column, pattern: str, group: int = 1) -> Column:
    """All matches of one group, with Unicode classes for ``\\b`` and ``\\s``."""
    return F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(group))


def rx_first(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of one group, or null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, "(?U)" + pattern, group), F.lit(""))


def rx_groups(c: Column, pattern: str, names: list[str]) -> Column:
    """One struct per match, one string field per group."""
    parts = [rx_all(c, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*parts)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, even where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def has_any(c: Column, terms: list[str]) -> Column:
    """True when any of the literal terms occurs."""
    cond = F.lit(False)
    for term in terms:
        cond = cond | F.contains(c, F.lit(term))
    return cond


def normalize(c: Column) -> Column:
    """Letters a-z, digits and Hangul only, lower case."""
    return F.lower(F.regexp_replace(text_or_empty(c), "[^0-9a-zA-Z가-힣]+", ""))


_KEPT = re.compile("[^0-9a-zA-Z가-힣]+")
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_DROPPED = bytes(b for b in range(128) if not chr(b).isalnum())


def normalized(value: str | None) -> str:
    if not value:
        return ""
    # most of what goes is ASCII; the pattern then has little left to take out
    plain = value.encode().translate(_LOWER, _DROPPED).decode()
    return plain if plain.isascii() else _KEPT.sub("", plain)


def of_distinct(c: pa.Array, use: Callable, kind: pa.DataType) -> pa.Array:
    """``use`` of every value, called once for values that repeat in the batch."""
    found = c.dictionary_encode("encode")
    made = pa.array([use(x) for x in found.dictionary.to_pylist()], kind)
    # rows of a batch without repeats need no second copy
    return made if len(made) == len(c) else made.take(found.indices)


def _normalized_all(c: pa.Array) -> pa.Array:
    return of_distinct(c, normalized, pa.string())


def normalize_long(c: Column) -> Column:
    """``normalize`` for long texts, where a pattern that stops at every blank is slow."""
    return F.arrow_udf(_normalized_all, "string")(c)


def normalize_any_script(c: Column) -> Column:
    """Lower case, every letter and number of any script kept."""
    return F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+", "")


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)\s+", "")


def clean_inline(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def strip_all(c: Column) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clip(c: Column, max_chars) -> Column:
    """Cut text over the limit, drop the space at the cut and add dots."""
    limit = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    cut = F.concat(F.rtrim(F.substring(c, F.lit(1), limit)), F.lit("..."))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def compact(c: Column, max_chars) -> Column:
    return clip(clean_inline(c), max_chars)


def issue_key(c: Column) -> Column:
    return rx_first(c, fv.ISSUE_KEY, 0)


def mention_tokens(c: Column) -> Column:
    return rx_all(c, fv.MENTION_TOKEN)


def general_terms(c: Column) -> Column:
    """Distinct lower-case alphanumeric runs of two or more characters."""
    runs = rx_all(text_or_empty(c), fv.GENERAL_TERM)
    kept = F.filter(F.transform(runs, F.lower), lambda t: F.length(t) > 1)
    return F.array_sort(F.array_distinct(kept))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))
    return (removed / F.octet_length(term)).cast("int")


def site_url(c: Column) -> Column:
    bare = F.regexp_replace(text_or_empty(c), "/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "/wiki$", ""), "/jira$", "")


def wiki_url(c: Column) -> Column:
    site = site_url(c)
    return F.when(F.contains(site, F.lit("atlassian.net")), F.concat(site, F.lit("/wiki"))).otherwise(site)


def absolute_url(path: Column, site: Column, base: Column) -> Column:
    return (
        F.when(F.startswith(path, F.lit("http")), path)
        .when(F.startswith(path, F.lit("/wiki")), F.concat(site, path))
        .otherwise(F.concat(base, F.lit("/"), F.regexp_replace(path, "^/+", "")))
    )


def content_url(webui: Column, kind: Column, item_id: Column, space_key: Column,
                link_base: Column, site: Column, base: Column) -> Column:
    """Link of a page or database: web link first, then a link by kind and id."""
    database = F.concat(
        F.coalesce(blank_to_null(link_base), site), F.lit("/wiki/spaces/"),
        text_or_empty(space_key), F.lit("/database/"), item_id,
    )
    view = F.concat(base, F.lit("/pages/viewpage.action?pageId="), item_id)
    return (
        F.when(blank_to_null(webui).isNotNull(), absolute_url(webui, site, base))
        .when(kind == "database", database)
        .otherwise(view)
    )
