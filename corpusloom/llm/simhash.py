"""Near-duplicates by 64-bit SimHash fingerprints, linked through BK-trees.

A fingerprint's bit is 1 if more than half of the text's word shingles have it in their hash. Fingerprints that differ in
at most ``radius`` bits are linked, and the connected components are the groups.

Texts with equal fingerprints are one node from the start. Nodes are dealt to shards: 64 bits are cut into ``radius + 2``
blocks, at least two of which are equal in any linked pair, so a shard is a pair of blocks and their values, and every
link shows in some shard. A shard's nodes form a BK-tree, in which a child hangs on its parent under their Hamming
distance; a search visits only edges whose distance is within the radius of the distance to the parent. A shard's tree
goes to the tasks that search it: an ordinary shard is one task's work, a large one is cut into trees of at most about
``LARGE`` nodes, each sent to the task of every part of the shard. All trees of a task are built and searched together,
level by level, with numpy. A task returns each local group as a star around its smallest node, which has no more links
than nodes, so dense groups of near-copies never become all their pairs.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other. Fewer words than a
shingle: the whole sequence is the shingle. Repeated rows are members of their group each. A null id is never a group's
name unless all are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import table, texts_of
from corpusloom.llm.components import components
from corpusloom.session import ship
from corpusloom.storage import stage

SEED, BITS = 42, 64
#: Nodes of a tree, about; nodes and searches handled at once.
LARGE, BLOCK, SEARCHES = 2048, 1 << 16, 256


def fingerprint(text: str | None, size: int) -> int:
    """Signed 64-bit SimHash of a text's shingles of ``size`` words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[size - 1:] if len(words) >= size else ends[-1:]
    of, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([of(joined[s:e], SEED) for s, e in zip(starts[at:min(n, at + BLOCK)].tolist(), stops[at:at + BLOCK].tolist(), strict=True)], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, fingerprint) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, size) for t in texts_of(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], [*keys, "fingerprint"])

    kept = docs.select(*keys, "text")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("fingerprint", T.LongType())]))


class Forest:
    """The BK-trees of several shards. ``shard`` is sorted; prints differ within a shard."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints, n = prints.astype(np.int64).view(np.uint64), len(prints)  # bits of signed numbers aren't counted as such
        self.shards, first = np.unique(shard, return_index=True)
        self.roots = first
        at = np.repeat(first, np.diff(np.append(first, n)))
        self.key = np.full(n, -1, np.int64)
        left = np.flatnonzero(np.arange(n) != at)
        while left.size:
            key = at[left] * (BITS + 1) + np.bitwise_count(self.prints[left] ^ self.prints[at[left]])
            kinds, head, which = np.unique(key, return_index=True, return_inverse=True)
            child = left[head]  # the first that comes with a distance becomes the child, the others go on below it
            self.key[child] = kinds
            at[left] = child[which]
            left = np.delete(left, head)
        children = np.flatnonzero(self.key >= 0)
        self.children = children[np.argsort(self.key[children], kind="stable")]
        self.edges = self.key[self.children]

    def search(self, shard: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of a search, node) for all nodes of its shard within the radius."""
        prints, where = prints.astype(np.int64).view(np.uint64), np.searchsorted(self.shards, shard)
        found = (where < len(self.shards)) & (self.shards[np.minimum(where, len(self.shards) - 1)] == shard)
        query = np.flatnonzero(found)
        node = self.roots[where[query]]
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while query.size:
            d = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            hits.append((query[near], node[near]))
            low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - low
            query = np.repeat(query, n)
            node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (query, node)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of linked entries; an entry's label is the smallest entry of its group."""
    while True:
        of_a, of_b = label[a], label[b]
        if (of_a == of_b).all():
            return
        np.minimum.at(label, np.maximum(of_a, of_b), np.minimum(of_a, of_b))  # a group's first entry takes all others with it
        while not ((below := label[label]) == label).all():
            label[:] = below


def _stars(shard: np.ndarray, prints: np.ndarray, in_tree: np.ndarray, searches: np.ndarray, radius: int) -> pa.RecordBatch | None:
    """Links of the groups that the searches of these shards find, as stars."""
    trees, asked = np.flatnonzero(in_tree), np.flatnonzero(searches)
    if not (trees.size and asked.size):
        return None
    forest, place = Forest(shard[trees], prints[trees]), np.argsort(np.argsort(prints, kind="stable"), kind="stable")
    entry = np.argsort(place)  # labels are ranks by print, so that the smallest label is the smallest print
    label = np.arange(len(prints))
    for at in range(0, len(asked), SEARCHES):
        some = asked[at:at + SEARCHES]
        query, node = forest.search(shard[some], prints[some], radius)
        _merge(label, place[some[query]], place[trees[node]])
    mine, head = np.arange(len(label)), label
    far = np.flatnonzero(head != mine)
    if not far.size:
        return None
    return pa.RecordBatch.from_pydict({"u": prints[entry[far]], "v": prints[entry[head[far]]]})


def _search_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(rows: np.ndarray):
            new = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            shard = np.concatenate([[0], np.cumsum(new)])
            return _stars(shard, rows[:, 4], rows[:, 5] == rows[:, 2], rows[:, 5] == rows[:, 3], radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            size += batch.num_rows
            if size >= BLOCK:
                rows = np.concatenate(held)
                cut = len(rows) - 1
                cut -= int(np.argmin(np.all(rows[::-1, :4] == rows[-1, :4], axis=1))) - 1 if not np.all(rows[:, :4] == rows[-1, :4]) else cut
                if cut:
                    if (out := flush(rows[:cut])) is not None:
                        yield out
                    rows = rows[cut:]
                held, size = [rows], len(rows)
        if size and (out := flush(np.concatenate(held))) is not None:
            yield out

    return run


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that connect all prints within the radius of each other; ``prints`` has each fingerprint once."""
    blocks = radius + 2
    ends = [round(BITS * (i + 1) / blocks) for i in range(blocks)]
    masks = [(1 << e) - (1 << s) for s, e in zip([0, *ends], ends, strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [signed(a | b) for a, b in combinations(masks, 2)]
    f = F.col("fingerprint")
    rows = prints.select(f, F.explode(F.array(*[F.struct(F.lit(i).alias("p"), f.bitwiseAND(F.lit(m)).alias("s")) for i, m in enumerate(pairs)])).alias("k")).select("k.p", "k.s", "fingerprint")
    # a shard of one has no links; its rows end here
    sizes = rows.groupBy("p", "s").agg(F.count("*").alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / LARGE).cast("long")
    part = F.pmod(F.xxhash64("fingerprint"), cut)
    met = rows.join(sizes, ["p", "s"]).select("p", "s", "fingerprint", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("other"))
    dealt = met.select(F.col("p").cast("long"), "s", F.least("part", "other").alias("tree"), F.greatest("part", "other").alias("asks"), "fingerprint", "part")
    keys = ["p", "s", "tree", "asks"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fingerprint").mapInArrow(_search_shards(radius), "u long, v long")


def groups(docs: DataFrame, size: int, radius: int, *keys: str) -> DataFrame:
    """(keys, fingerprint, component_id) of every row; component_id is the smallest first key of the row's group."""
    prints = stage(fingerprints(docs, size, *keys), "fingerprints")
    nodes = stage(prints.groupBy("fingerprint").agg(F.min(keys[0]).alias("first")), "nodes")
    found = stage(links(nodes.select("fingerprint"), radius), "stars")
    roots = components(found)
    tagged = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    tagged = stage(tagged, "tagged")
    names = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(tagged.select("fingerprint", "root").join(names, "root").drop("root"), "fingerprint").select(*keys, "fingerprint", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: shingles of four words, at most four differing bits."""
    ship(spark)
    found = groups(table(spark, sf_dir, "documents"), 4, 4, "doc_id")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
