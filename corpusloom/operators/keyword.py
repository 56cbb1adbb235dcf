"""Keyword retrieval: term gates, field scores and the best chunk per page."""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import korean
from corpusloom.functions.text import normalize
from corpusloom.operators import keyword_blocks, units
from corpusloom.operators.matching import TermFilter, blocks, find, term_filter
from corpusloom.operators.ranking import best_per_key, positive_limit, score_key, top_k
from corpusloom.storage import stage

FIELDS = {"title": 3.0, "keyword": 2.0, "content": 1.0}


def query_terms(queries: DataFrame, now_year: int) -> DataFrame:
    """(query_id, term, is_exact, is_broad) by the Korean question rules."""
    both = queries.select(
        "query_id", korean.exact_terms(F.col("query"), now_year).alias("exact"),
        korean.broad_terms(F.col("query")).alias("broad"),
    )
    return both.select("query_id", "exact", "broad", F.explode(F.array_union("exact", "broad")).alias("term")).select(
        "query_id", "term", F.array_contains("exact", F.col("term")).alias("is_exact"),
        F.array_contains("broad", F.col("term")).alias("is_broad"),
    )


def searchable_chunks(chunks: DataFrame, now_year: int) -> DataFrame:
    """Chunk keys with the three normalised fields, their lengths and the months of the locator."""
    def field(c: Column) -> Column:
        return korean.searchable_long(c, now_year)

    base = chunks.filter(F.length("page_content") > 0).select(
        "chunk_id", "page_id", field(F.coalesce("title", F.lit(""))).alias("title"), field(F.coalesce("breadcrumb", F.lit(""))).alias("crumb"),
        F.concat(normalize(F.col("space_name")), normalize(F.col("space"))).alias("place"), field(F.col("page_content")).alias("content"),
        korean.locator_months_long(korean.locator(F.col("title"), F.col("breadcrumb"))).alias("months"),
    )
    return base.select(
        "chunk_id", "page_id", "title", F.concat("crumb", "place").alias("keyword"), "content", "months",
        F.concat("title", "crumb", "content").alias("gate"),
    )


_FACT = pa.struct([("term", pa.string()), ("in_gate", pa.bool_()), ("in_head", pa.bool_()), *((f"tf_{f}", pa.int32()) for f in FIELDS)])


# fields by number, and what else a window may lie in: across the fields of the gate, across those of the head
_TITLE, _KEYWORD, _CONTENT, _GATE, _HEAD, _PARTS = range(6)


@lru_cache(maxsize=1 << 16)
def _repeats(word: bytes) -> bool:
    """Whether a word may overlap with itself."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def _apart(group: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which windows are counted: those of each group that don't overlap, taken from the left. The windows of a group stand by start."""
    order = np.argsort(group, kind="stable")
    group, starts, length, kept = group[order], starts[order], length[order], np.ones(len(order), bool)
    close = np.flatnonzero((np.diff(group) == 0) & (np.diff(starts) < length[1:]))
    for first in np.unique(np.searchsorted(group, group[close])).tolist():
        end, i = -1, first
        while i < len(group) and group[i] == group[first]:
            kept[i] = starts[i] >= end
            end = starts[i] + length[i] if kept[i] else end
            i += 1
    out = np.empty(len(order), bool)
    out[order] = kept
    return out


def _numbered(values: Iterable[tuple]) -> tuple[list[tuple], np.ndarray]:
    """The distinct values, and the number of each among them."""
    number: dict[tuple, int] = {}
    which = np.array([number.setdefault(v, len(number)) for v in values], np.int64)
    return list(number), which


def _block_facts(titles: list[bytes], keywords: list[bytes], contents: list[bytes], gates: list[bytes], terms: TermFilter) -> pa.ListArray:
    """What each chunk of a block has of the terms: its counts per field, and whether gate and head hold it."""
    n = len(titles)
    # chunks of a page share all but their text: that is searched and counted once for all of them
    before = [len(g) - min(len(g), len(c)) for g, c in zip(gates, contents, strict=True)]
    back = [min(k, max(terms.lengths, default=1) - 1) for k in before]
    pages, page = _numbered(zip((g[:k] for g, k in zip(gates, before, strict=True)), titles, keywords, strict=True))
    hits = find([*(g[k - b:] for g, k, b in zip(gates, before, back, strict=True)), *(x[0] for x in pages), *(x[1] + x[2] for x in pages)], terms)
    sizes = lambda texts: np.array([len(t) for t in texts], np.int64)
    of_page = sizes([x[1] for x in pages])
    before, back = np.array(before, np.int64), np.array(back, np.int64)
    # where each segment begins in its gate, where its title ends and its content begins, and whose it is
    shift, title = np.concatenate([before - back, np.zeros(2 * len(pages), np.int64)]), np.concatenate([of_page[page], of_page, of_page])
    content, owner = np.concatenate([before, sizes([x[0] for x in pages]), np.zeros(len(pages), np.int64)]), np.concatenate([np.arange(n), *[n + np.arange(len(pages))] * 2])
    own = hits.segment >= n
    own[~own] = (hits.start + hits.length)[~own] > back[hits.segment[~own]]
    segment, length, code = hits.segment[own], hits.length[own], hits.code[own]
    start = hits.start[own] + shift[segment]
    # a window counts for the field it lies in; what spans two fields only opens the gate
    in_head = segment >= n + len(pages)
    part = np.where(start + length <= title[segment], _TITLE, _GATE)
    part[(segment < n) & (start >= content[segment])] = _CONTENT
    part[in_head] = np.where(start >= title[segment], _KEYWORD, _HEAD)[in_head]
    width = max(1, len(hits.words))
    repeats = np.array([_repeats(w) for w in hits.words.to_pylist()], bool)
    some = np.flatnonzero(repeats[code]) if len(code) else code
    counted = np.ones(len(code), bool)
    counted[some] = _apart((segment[some] * width + code[some]) * _PARTS + part[some], start[some], length[some])
    found = pa.array(owner[segment] * width + code).dictionary_encode()
    pair, which = found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)
    counts = np.bincount(which[counted] * _PARTS + part[counted], minlength=len(pair) * _PARTS).reshape(-1, _PARTS)
    # what a page has is in each of its chunks
    order = np.argsort(pair)
    pair, counts = pair[order], counts[order]
    edges = np.searchsorted(pair, (n + np.arange(len(pages) + 1)) * width)
    many = np.diff(edges)[page]
    chunk = np.repeat(np.arange(n), many)
    copied = np.arange(len(chunk)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(edges[:-1][page], many)
    pair = np.concatenate([pair[:edges[0]], chunk * width + pair[copied] % width])
    order = np.argsort(pair, kind="stable")
    pair, counts = pair[order], np.concatenate([counts[:edges[0]], counts[copied]])[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    pair, counts = pair[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts
    row, word = np.divmod(pair, width)
    columns = [hits.words.take(pa.array(word)).cast(pa.string()), *(pa.array(counts[:, parts].any(axis=1)) for parts in ([_TITLE, _CONTENT, _GATE], [_KEYWORD, _HEAD]))]
    columns += [pa.array(counts[:, k].astype(np.int32)) for k in range(len(FIELDS))]
    facts = pa.StructArray.from_arrays(columns, fields=list(_FACT))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), facts)


def _scanned(batches: Iterable[pa.RecordBatch], terms: TermFilter, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("title", "keyword", "content", "gate")]
        for a, b in blocks([len(x) + len(y) for x, y in zip(fields[1], fields[3], strict=True)]):
            facts = _block_facts(*(f[a:b] for f in fields), terms)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), facts], [*kept, "facts"])


def _to_scan(texts: DataFrame, months: Column | str = "months") -> DataFrame:
    return texts.select("chunk_id", "page_id", months, *_lengths(), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "keyword", "content", "gate")])


def scan_chunks(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per chunk: lengths, months and, for every term found, its count per field.

    Among the terms of ``facts`` there may be a few strings nobody asked for (see ``matching``); later steps join on the term.
    """
    shared = texts.sparkSession.sparkContext.broadcast(term_filter(terms))
    counts = ", ".join(f"tf_{f}: int" for f in FIELDS)
    lengths = ", ".join(f"{c} int" for c in LENGTHS)
    months = texts.schema["months"].dataType.simpleString()
    return _to_scan(texts).mapInArrow(
        lambda batches: _scanned(batches, shared.value, KEPT),
        f"chunk_id string, page_id string, months {months}, {lengths}, facts array<struct<term: string, in_gate: boolean, in_head: boolean, {counts}>>")


LENGTHS = [f"len_{f}" for f in FIELDS]
KEPT = ["chunk_id", "page_id", "months", *LENGTHS]


def _lengths() -> list[Column]:
    return [F.greatest(F.lit(1), F.length(f)).alias(f"len_{f}") for f in FIELDS]


def _queries(terms: DataFrame, months: DataFrame | None) -> DataFrame:
    """One row per query: its months, term count and which gate applies."""
    kinds = terms.groupBy("query_id").agg(
        F.max("is_exact").alias("has_exact"), F.max("is_broad").alias("has_broad"), F.count("*").alias("n_terms")
    )
    if months is None:
        kinds = kinds.withColumn("asked", F.array().cast("array<int>"))
    else:
        kinds = kinds.join(months.select("query_id", F.col("months").alias("asked")), "query_id", "full")
    asked = F.coalesce("asked", F.array().cast("array<int>"))
    exact = F.coalesce("has_exact", F.lit(False))
    return kinds.select(
        "query_id", asked.alias("asked"), exact.alias("has_exact"),
        F.coalesce("has_broad", F.lit(False)).alias("has_broad"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        F.when(exact, "exact").when(F.size(asked) > 0, "month").otherwise("open").alias("gate"),
    ).filter((F.col("n_terms") > 0) | (F.size("asked") > 0))


@dataclass
class Prepared:
    """What the keyword steps share: blocks of scanned chunks, terms, query facts and the blocks of queries."""

    blocks: DataFrame
    terms: DataFrame
    queries: DataFrame
    asks: DataFrame


WEIGHTS = list(FIELDS.items())
COUNTS = [f"df_{f}" for f in FIELDS]


def _scanned_blocks(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Chunks as they were scanned, in blocks. Only rows whose id repeats are dealt anew, so that they stand together."""
    shared = texts.sparkSession.sparkContext.broadcast(term_filter(terms))
    copies = stage(texts.groupBy(F.col("chunk_id").alias("_id")).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col("_id").isNull()).select("_id"), "copies")
    same = F.col("chunk_id").eqNullSafe(F.col("_id"))
    once = texts.join(copies, same, "left_anti")
    again = texts.join(copies, same, "left_semi").repartition("chunk_id").sortWithinPartitions("chunk_id")
    # what is found is packed by the task that finds it; its many small parts never become rows
    packed = [_to_scan(rows, keyword_blocks.month_mask(F.col("months")).alias("months")).mapInArrow(
        lambda batches: keyword_blocks.chunk_blocks(_scanned(batches, shared.value, KEPT), list(FIELDS)), keyword_blocks.BLOCKS) for rows in (once, again)]
    return stage(packed[0].unionByName(packed[1].withColumn("block", -F.col("block"))), "scanned_blocks")


def _asked(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, gate, has_broad, asked, n_terms, terms) of every query with an id."""
    listed = terms.filter(F.col("term").isNotNull()).groupBy("query_id", "term").agg(
        F.coalesce(F.max("is_exact"), F.lit(False)).alias("is_exact"), F.coalesce(F.max("is_broad"), F.lit(False)).alias("is_broad"), F.count("*").alias("times"))
    return queries.filter(F.col("query_id").isNotNull()).join(listed, "query_id", "left").select(
        F.col("query_id").cast("string").alias("query_id"), "gate", "has_broad", keyword_blocks.month_mask(F.col("asked")).alias("asked"), "n_terms",
        "term", "is_exact", "is_broad", "times")


def _ask_blocks(asked: DataFrame, name: str, counts: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    fact = F.struct("term", "is_exact", "is_broad", "times", *counts)
    listed = asked.groupBy("query_id", "gate", "has_broad", "asked", "n_terms", *numbers).agg(
        F.collect_list(F.when(F.col("term").isNotNull(), fact)).alias("terms"))
    # all blocks but those of very large batches are full
    return stage(units.ask_blocks(listed.withColumn("area", F.lit("")).coalesce(max(1, listed.sparkSession.sparkContext.defaultParallelism // 4)), keyword_blocks.QUERIES), name)


def prepare(chunks: DataFrame, terms: DataFrame, months: DataFrame | None, now_year: int) -> Prepared:
    """Scan the chunks once for all terms; every later step works on what was found.

    ``chunks`` may be the result of ``searchable_chunks``, which ingest can write once for all batches.
    """
    texts = chunks if "gate" in chunks.columns else searchable_chunks(chunks, now_year)
    queries = _queries(terms, months)
    closed = _asked(queries, terms).filter(F.col("gate") != "open")
    return Prepared(_scanned_blocks(texts, terms), terms, queries, _ask_blocks(closed, "gates"))


def gated_chunks(p: Prepared) -> DataFrame:
    """(query_id, chunk_id) of queries with an exact term or a month: the chunks their gate admits."""
    return keyword_blocks.gated_pairs(p.blocks, p.asks, WEIGHTS)


def _means(sums: DataFrame) -> DataFrame:
    return sums.select(*[c for c in sums.columns if c not in (*LENGTHS, *COUNTS)], *[(F.col(c) / F.col("n")).alias("avg_" + c) for c in LENGTHS])


def _whole(counts: DataFrame) -> DataFrame:
    """One row: count and mean field lengths of the whole table, which open queries share."""
    return _means(counts.filter(F.col("term").isNull())).drop("term").withColumn("gate", F.lit("open"))


def candidate_stats(p: Prepared) -> DataFrame:
    """Candidate count and mean field lengths per query; open queries share the values of the whole table."""
    gated = _means(keyword_blocks.gate_stats(p.blocks, p.asks, WEIGHTS).filter(F.col("term").isNull())).drop("term")
    whole = _whole(stage(keyword_blocks.document_counts(p.blocks, list(FIELDS)), "document_counts"))
    open_ = p.queries.filter(F.col("gate") == "open").select("query_id", "gate").join(whole, "gate")
    return gated.unionByName(open_.drop("gate"))


def _scoring_asks(p: Prepared) -> DataFrame:
    """Blocks of queries with the counts their scores need: of the whole table for open queries, of admitted chunks for others."""
    asked = _asked(p.queries, p.terms)
    of_all = stage(keyword_blocks.document_counts(p.blocks, list(FIELDS)), "document_counts")
    of_gates = stage(keyword_blocks.gate_stats(p.blocks, p.asks, WEIGHTS), "gate_stats")
    numbers = ["n", *["avg_" + c for c in LENGTHS]]
    open_ = asked.filter(F.col("gate") == "open").join(of_all.select("term", *COUNTS), "term", "left").join(_whole(of_all), "gate")
    closed = asked.filter(F.col("gate") != "open").join(of_gates.select("query_id", "term", *COUNTS), ["query_id", "term"], "left").join(
        _means(of_gates.filter(F.col("term").isNull())).drop("term"), "query_id")
    every = open_.unionByName(closed).withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})
    return _ask_blocks(every, "asks", COUNTS, numbers)


def field_scores(p: Prepared) -> DataFrame:
    """(query, chunk) with the three-field score and the share of terms found in the title: a row for every pair."""
    return keyword_blocks.every_score(p.blocks, _scoring_asks(p), WEIGHTS)


def page_scores(p: Prepared, k: int) -> DataFrame:
    """The rows of ``field_scores`` that can be among the first k pages of their query.

    Queries match chunks all over the table, so their pairs are never made: blocks of queries meet blocks of chunks,
    and each task returns k pages per query (see ``keyword_blocks``).
    """
    return keyword_blocks.best_pages(p.blocks, _scoring_asks(p), WEIGHTS, k)


def rank_pages(scores: DataFrame, limits: DataFrame | None = None, k: int = fv.KEYWORD_TOP_K,
               max_k: int | None = None) -> DataFrame:
    """Best chunk per page, then the first k pages per query; ``limits`` (query_id, k) overrides k."""
    total = score_key(F.col("bm25_score") + F.col("title_match_score"))
    keyed = scores.withColumn("page_key", F.coalesce("page_id", "chunk_id")).withColumn("total", total)
    best = best_per_key(keyed, ["query_id", "page_key"], [-F.col("total"), F.col("chunk_id")])
    order = [F.desc("total"), F.col("chunk_id")]
    if limits is None:
        return top_k(best, ["query_id"], order, k).drop("page_key")
    joined = best.join(limits.select("query_id", F.col("k").alias("_k")), "query_id", "left")
    cut = positive_limit(F.col("_k"), k)
    return top_k(joined, ["query_id"], order, max(max_k or k, k), cut).drop("page_key", "_k")


def search(chunks: DataFrame, terms: DataFrame, now_year: int, months: DataFrame | None = None,
           limits: DataFrame | None = None, k: int = fv.KEYWORD_TOP_K, max_k: int | None = None) -> DataFrame:
    """Ranked chunks per query from the keyword rules."""
    prepared = prepare(chunks, terms, months, now_year)
    return rank_pages(page_scores(prepared, max(max_k or k, k)), limits, k, max_k)
