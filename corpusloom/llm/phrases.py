"""Phrase collocations from depth-truncated suffix subtrees, built group by group under a memory budget.

The words of a text are its symbols; every word begins a suffix, cut after ``depth`` words or at the end of its piece. As in
ERA's vertical partitioning, prefixes are counted first: single words, and one word more below each prefix that is more
frequent than the budget, level by level. Neighbouring prefixes are then put together to groups whose suffixes fit the
budget (virtual trees). A second reading of the texts deals the suffixes to their groups, each block of text as a small
sorted tree of its own, so equal suffixes of a block travel once; a group's trees are merged to one sorted array of leaves,
and the count of every node is the sum of the leaves below it. A hot word, pair or passage is one path per block, and a
prefix above the budget is spread over several groups; its own count is known from the first readings.

The driver holds the prefixes above the budget and the first prefix of each group, at most the number of words divided by
the budget, plus one for each partition of the sort; both are broadcast. All counts are exact, and scores are whole numbers.

Defined results: a null or empty text, or one without a word, adds nothing; a null language is ``und``. Rows are counted as
often as they stand in the table, whatever their ids. Texts are cut to blocks at gaps between words, with the words that
reach over the cut read along, so a text of any length is counted whole. An empty table gives no rows. Other columns are
ignored. Ties end with the phrase.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table, texts_of
from corpusloom.session import ship
from corpusloom.storage import stage

DEPTH, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Suffixes of a group, and bytes of text whose suffixes make one tree before they are dealt.
BUDGET, BLOCK = 2_000_000, 8 << 20

#: Bytes between words, and bytes between pieces.
_GAPS, _ENDS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAPS)], _KIND[list(_ENDS)] = 1, 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAK = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_JOIN = b"\x20"


def _chunks(text: bytes, size: int, depth: int) -> Iterator[tuple[bytes, int]]:
    """A long text cut between words: (bytes, how many of them are the chunk's own; the rest is read along)."""
    reach = re.compile(rb"(?:[\x20\x09]+[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % (depth - 1))
    at = 0
    while len(text) - at > size:
        gap = _BREAK.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:reach.match(text, end).end()], end - at
        at = end
    yield text[at:], len(text) - at


def _text_blocks(batches: Iterator[pa.RecordBatch], depth: int, size: int) -> Iterator[tuple[str, bytes, int]]:
    """(language, lower-cased bytes of one or more texts, own bytes) of at most about ``size`` bytes."""
    held: dict[str, list[bytes]] = {}
    room = 0

    def joined() -> Iterator[tuple[str, bytes, int]]:
        for lang, texts in held.items():
            block = b"\n".join(texts)
            yield lang, block, len(block)

    for batch in batches:
        raws = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        for lang, raw in zip(texts_of(batch, "lang"), raws, strict=True):
            low = raw.translate(_LOWER)
            if len(low) > size:
                for chunk, own in _chunks(low, size, depth):
                    yield lang, chunk, own
                continue
            held.setdefault(lang, []).append(low)
            room += len(low) + 1
            if room >= size:
                yield from joined()
                held, room = {}, 0
    yield from joined()


class Suffixes:
    """The suffixes of a block: sorted words, and for each suffix its words as numbers, -1 past the end of a piece."""

    def __init__(self, block: bytes, own: int, depth: int):
        raw = np.frombuffer(block, np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        self.words, numbers = _numbered(words)
        mine = int(np.searchsorted(starts, own))
        self.columns = [numbers[:mine]]
        for k in range(1, depth):
            follows = np.full(mine, -1, np.int32)
            reach = min(mine, max(0, len(numbers) - k))
            same = piece[k:k + reach] == piece[:reach]
            follows[:reach][same] = numbers[k:k + reach][same]
            self.columns.append(follows)


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in byte order, and each word's number among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _keys(columns: list[np.ndarray], words: int) -> np.ndarray:
    """One number for each row of columns, in the order of the rows."""
    key, top = columns[0].astype(np.int64), max(words, 1)
    for column in columns[1:]:
        if top * (words + 1) >= 1 << 62:
            kept, key = np.unique(key, return_inverse=True)
            top = len(kept)
        key = key * (words + 1) + (column + 1)
        top *= words + 1
    return key


def _leaves(columns: list[np.ndarray], words: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows in order, and how often each stands there."""
    key = _keys(columns, words)
    if not len(key):
        return columns, np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weights = np.ones(len(key), np.int64) if counts is None else counts[order]
    return [c[order[first]] for c in columns], np.add.reduceat(weights, first)


def _path(words: list[bytes], numbers) -> bytes:
    return _JOIN.join(words[i] for i in numbers if i >= 0)


def _utf8(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _own_texts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _prefix_counts(texts: DataFrame, length: int, heavy: set[tuple[str, bytes]], depth: int, size: int) -> DataFrame:
    """(lang, prefix, n) of the prefixes of ``length`` words; beyond one word only below the heavy ones."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block, own in _text_blocks(batches, depth, size):
            tree = Suffixes(block, own, depth)
            columns = tree.columns[:length]
            if length > 1:
                wanted = [p for x, p in shared.value if x == lang]
                at = _positions(tree.words, sorted({w for p in wanted for w in p.split(_JOIN)}))
                rows = np.flatnonzero(np.isin(columns[0], list({at[p.split(_JOIN)[0]] for p in wanted} - {-1})))
                for k in range(1, length - 1):
                    rows = rows[np.isin(columns[k][rows], list({at[p.split(_JOIN)[k]] for p in wanted} - {-1}))]
                columns = [c[rows] for c in columns]
            found, counts = _leaves(columns, len(tree.words))
            if length == 1:
                prefixes = tree.words.take(pa.array(found[0])).cast(pa.string())
            else:
                names = tree.words.to_pylist()
                paths = [_path(names, row) for row in zip(*(c.tolist() for c in found), strict=True)]
                above = [_path(names, row) for row in zip(*(c.tolist() for c in found[:-1]), strict=True)]
                keep = [i for i, p in enumerate(above) if (lang, p) in shared.value]
                prefixes, counts = _utf8([paths[i] for i in keep]), counts[keep]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(prefixes)), prefixes, pa.array(counts, pa.int64())], ["lang", "prefix", "n"])

    return texts.mapInArrow(run, "lang string, prefix string, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def _positions(words: pa.Array, wanted: list[bytes]) -> dict[bytes, int]:
    found = pc.index_in(pa.array(wanted, pa.binary()), words)
    return {w: -1 if i is None else i for w, i in zip(wanted, found.to_pylist(), strict=True)}


def _order_key() -> F.Column:
    return F.concat_ws("\n", "lang", "prefix").cast("binary")


def _groups(prefixes: DataFrame, budget: int) -> list[bytes]:
    """The first prefix of each group: neighbours in byte order are put together while their suffixes fit the budget."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            first = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or held + n > budget:
                    first.append(key)
                    held = 0
                held += n
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary())], ["key"])

    ordered = prefixes.select(_order_key().alias("key"), "n").repartitionByRange("key").sortWithinPartitions("key")
    return sorted(r["key"] for r in ordered.mapInArrow(cut, "key binary").collect())


class Plan:
    """Which group a suffix belongs to: that of its shortest prefix that is within the budget."""

    def __init__(self, heavy: list[set[tuple[str, bytes]]], firsts: list[bytes]):
        self.heavy, self.firsts = heavy, firsts

    def group(self, lang: str, prefix: bytes) -> int:
        return bisect_right(self.firsts, lang.encode() + b"\n" + prefix)

    def groups(self, lang: str, tree: Suffixes, leaves: list[np.ndarray]) -> np.ndarray:
        names = tree.words.to_pylist()
        first = leaves[0]
        by_word = np.zeros(len(names), np.int64)
        heavy = np.zeros(len(names), bool)
        present = np.unique(first)
        for i in present.tolist():
            by_word[i] = self.group(lang, names[i])
        for word, at in _positions(tree.words, [p for x, p in self.heavy[0] if x == lang]).items():
            if at >= 0:
                heavy[at] = True
        out = by_word[first]
        seen: dict[tuple, int] = {}
        rows = np.flatnonzero(heavy[first])
        for i, row in zip(rows.tolist(), zip(*(c[rows].tolist() for c in leaves), strict=True), strict=True):
            length = 1
            while length < len(row) and length <= len(self.heavy) and (lang, _path(names, row[:length])) in self.heavy[length - 1]:
                length += 1
                if row[length - 1] < 0:
                    break
            place = row[:length]
            if place not in seen:
                seen[place] = self.group(lang, _path(names, place))
            out[i] = seen[place]
        return out


def _dealt(texts: DataFrame, plan, depth: int, size: int) -> DataFrame:
    """The trees of the blocks, cut to groups: words, leaves as numbers of the words plus one, and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block, own in _text_blocks(batches, depth, size):
            tree = Suffixes(block, own, depth)
            leaves, counts = _leaves(tree.columns, len(tree.words))
            if not len(counts):
                continue
            groups = plan.value.groups(lang, tree, leaves)
            order = np.argsort(groups, kind="stable")
            bounds = np.flatnonzero(np.diff(np.concatenate([[-1], groups[order]])))
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
                rows = order[a:b]
                cell = np.stack([leaf[rows] for leaf in leaves])
                used = np.unique(cell)
                used = used[used >= 0]
                small = np.where(cell < 0, 0, np.searchsorted(used, cell) + 1).astype("<u2" if len(used) < 65535 else "<u4")
                number = counts[rows]
                packed = number.astype("<u1" if number.max() < 256 else "<u8")
                words = b"\n".join(tree.words.take(pa.array(used)).to_pylist())
                yield pa.RecordBatch.from_pydict({"group": pa.array([int(groups[rows[0]])], pa.int64()), "lang": [lang], "words": pa.array([words], pa.binary()), "n": pa.array([b - a], pa.int32()),
                                                  "leaves": pa.array([small.tobytes()], pa.binary()), "counts": pa.array([packed.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "group long, lang string, words binary, n int, leaves binary, counts binary")


def _merged(cells: pa.Table, depth: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The trees of one group as one: words, leaves in order, counts."""
    names, parts, counts, base = [], [], [], 0
    for row in cells.to_pylist():
        words, n = row["words"].split(b"\n"), row["n"]
        cell = np.frombuffer(row["leaves"], f"<u{len(row['leaves']) // (n * depth)}").reshape(depth, n).astype(np.int64)
        parts.append(np.where(cell == 0, -1, cell - 1 + base))
        counts.append(np.frombuffer(row["counts"], f"<u{len(row['counts']) // n}").astype(np.int64))
        names.append(pa.array(words, pa.binary()))
        base += len(words)
    words, rank = _numbered(pa.concat_arrays(names))
    cell = np.concatenate(parts, axis=1)
    columns = [np.where(c < 0, -1, rank[c]).astype(np.int32) for c in cell]
    leaves, totals = _leaves(columns, len(words), np.concatenate(counts))
    return words, leaves, totals


def _frequent(dealt: DataFrame, plan, depth: int, least: int) -> DataFrame:
    """(lang, phrase, n) of the nodes of two words and more whose leaves sum to ``least``; pairs above the budget are not among them."""
    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        lang = key[1].as_py()
        words, leaves, counts = _merged(cells, depth)
        phrases, numbers = [], []
        below = np.concatenate([[0], np.cumsum(counts)])
        changed = np.zeros(len(counts), bool)
        changed[0] = True
        changed[1:] |= leaves[0][1:] != leaves[0][:-1]
        for level in range(1, depth):
            changed[1:] |= leaves[level][1:] != leaves[level][:-1]
            start = np.flatnonzero(changed)
            end = np.append(start[1:], len(counts))
            total = below[end] - below[start]
            often = np.flatnonzero((total >= least) & (leaves[level][start] >= 0))
            at = start[often]
            parts = [words.take(pa.array(leaves[k][at])) for k in range(level + 1)]
            paths = pc.binary_join_element_wise(*parts, pa.scalar(_JOIN, pa.binary())).to_pylist()
            spread = plan.value.heavy[level] if level < len(plan.value.heavy) else ()
            keep = [i for i, p in enumerate(paths) if (lang, p) not in spread]
            phrases += [paths[i] for i in keep]
            numbers.append(total[often][keep])
        return pa.table({"lang": pa.repeat(pa.scalar(lang), len(phrases)), "phrase": _utf8(phrases), "n": pa.array(np.concatenate(numbers), pa.int64())})

    return dealt.groupBy("group", "lang").applyInArrow(run, "lang string, phrase string, n long")


def frequencies(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, budget: int = BUDGET, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases of up to ``depth`` words that occur ``least`` times, (lang, n) of all words)."""
    spark, texts = docs.sparkSession, _own_texts(docs)
    levels = [stage(_prefix_counts(texts, 1, set(), depth, size), "prefixes")]
    heavy: list[set[tuple[str, bytes]]] = []
    while len(heavy) < depth - 1:
        over = {(r["lang"], r["prefix"].encode()) for r in levels[-1].where(F.col("n") > budget).collect()}
        # a prefix that ends with its piece is a leaf and can't be extended
        over = {(lang, p) for lang, p in over if len(p.split(_JOIN)) == len(levels)}
        if not over:
            break
        heavy.append(over)
        levels.append(stage(_prefix_counts(texts, len(levels) + 1, over, depth, size), "prefixes"))
    heavy = heavy or [set()]
    atoms = levels[-1]
    for k, level in enumerate(levels[:-1]):
        long = spark.createDataFrame([(lang, p.decode()) for lang, p in heavy[k]], "lang string, prefix string")
        atoms = atoms.unionByName(level.join(long, ["lang", "prefix"], "left_anti"))
    plan = spark.sparkContext.broadcast(Plan(heavy, _groups(atoms, budget)))
    nodes = _frequent(_dealt(texts, plan, depth, size), plan, depth, least)
    known = levels[0].where(F.col("n") >= least).select("lang", F.col("prefix").alias("phrase"), "n")
    for k, level in enumerate(levels[1:], 2):
        # counts of pairs above the budget; the others stand in one group each and are read there
        over = level.where((F.col("n") > budget) & (F.col("n") >= least) & (F.size(F.split("prefix", " ")) == k))
        if k <= len(heavy):
            known = known.unionByName(over.select("lang", F.col("prefix").alias("phrase"), "n"))
    return stage(nodes.unionByName(known), "phrases"), levels[0].groupBy("lang").agg(F.sum("n").alias("total"))


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, covered: int = COVERED, top: int = TOP,
                 budget: int = BUDGET, size: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words, cut): the best phrases of each language.

    A phrase's score is that of its weakest cut in two, floor(1000000 a a / (l r)); a phrase goes if a longer one that
    holds it is at least ``covered`` hundredths as frequent.
    """
    known, totals = frequencies(docs, depth, least, budget, size)
    found = known.withColumn("words", F.size(F.split("phrase", " ")))
    candidates = found.where("words > 1")
    cut = (candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
           .withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)")))
    ends = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(ends("first", "l"), ["lang", "first"]).join(ends("rest", "r"), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    scored = cut.withColumn("score", F.expr(f"({wide('n')} * {wide('n')} * 1000000) div ({wide('l')} * {wide('r')})"))
    weakest = scored.groupBy("lang", "phrase").agg(F.first("n").alias("a"), F.first("words").alias("words"), F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    pieces = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(pieces, i, k), " "))))
    holders = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = weakest.join(holders, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * a")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "at.l", "at.r", F.col("total").alias("n"), "at.score", "words", "at.cut")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language, over all documents."""
    ship(spark)
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
