"""Removal of near-copies: SimHash candidates from BK-trees, confirmed by the similarity of their shingles.

Two texts are near-copies if the sets of their shingles of ``size`` words have a Jaccard similarity of ``similarity`` or
more. Radius searches over 64 bits alone would have to be wide for that, so shards are made by min-hashes instead of bits: a text is
in one shard for each of ``KEYS`` hash functions, named by the least hash of its shingles, and texts as similar as that
share one with a probability of 1 - 0.2 ** KEYS at least. A shard's fingerprints form a BK-tree. They are made of each
text's different shingles, as the similarity is, so that the distance of two texts follows from their similarity alone,
however often passages repeat; the search goes as far as ``radius_of`` says for a miss rate of ``MISS``. What is found is compared by 64 min-hashes and then by the shingles themselves: all of them up to
``KEPT``. Of larger sets the ``KEPT`` least hashes are a sample that decides only pairs ``DEVIATIONS`` standard deviations away
from the similarity asked for; pairs nearer to it are settled by counting what their whole sets share. Large shards are cut into trees and
parts as in ``simhash``. A pair is compared only while its texts are not yet in one group, and a task returns stars.

Defined results: null, empty and blank texts are copies of each other. Fewer words than a shingle: the whole sequence is
the shingle. Ids may repeat: a row is known by its id and a hash of its columns, and of rows equal in both one stays.
Of each group the row with the smallest id stays, null ids last, ties by that hash. All columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import texts_of
from corpusloom.llm.components import components
from corpusloom.llm.simhash import BITS, LARGE, SEARCHES, SEED, Forest, _merge
from corpusloom.storage import stage

KEYS, HASHES, KEPT = 6, 64, 1024
#: Standard deviations from the similarity asked for within which a sample doesn't decide; hashes of a slice of a whole set, about.
DEVIATIONS, SLICE = 4, 256
#: Share of pairs, as similar as asked for, that the search by fingerprints may miss, and that the comparison of min-hashes may.
MISS = 1e-5
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at once; rows of a task searched together, beside whole shards.
_PART, ROWS = 1 << 14, 1 << 12
#: Shingle sets held at once.
SETS = 512


def _tail(n: int, p: float, least: int) -> float:
    """Probability of ``least`` or more of ``n``."""
    return sum(comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(least, n + 1))


def _bit_differs(both: int, a: int, b: int) -> float:
    """Probability that a fingerprint bit differs between sets that share ``both`` shingles and have ``a`` and ``b`` of their own."""
    odds = lambda n: np.array([comb(n, k) for k in range(n + 1)]) / 2.0 ** n
    common = np.arange(both + 1)[:, None]
    set_a = (2 * (common + np.arange(a + 1)) > both + a) @ odds(a)
    set_b = (2 * (common + np.arange(b + 1)) > both + b) @ odds(b)
    return float(odds(both) @ (set_a + set_b - 2 * set_a * set_b))


@cache
def radius_of(similarity: float) -> int:
    """Bits within which the fingerprints of all but ``MISS`` of the pairs of this similarity lie, whatever their sizes.

    Bits are independent of each other, so a distance is binomial. Small sets are counted out; for large ones a bit is
    the sign of two normal sums whose correlation is least if both sets have the same size.
    """
    worst = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    for union in range(1, 41):
        for both in range(int(np.ceil(similarity * union - 1e-9)), union + 1):
            for a in range((union - both) // 2 + 1):
                worst = max(worst, _bit_differs(both, a, union - both - a))
    return next(r for r in range(BITS + 1) if _tail(BITS, worst, r + 1) <= MISS)


@cache
def least_equal(similarity: float) -> float:
    """Share of equal min-hashes that all but ``MISS`` of the pairs of this similarity have."""
    return next(k for k in range(HASHES, -1, -1) if 1 - _tail(HASHES, similarity, k) <= MISS) / HASHES


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    stops = ends[size - 1:] if len(words) >= size else ends[-1:]
    of = xxhash.xxh64_intdigest
    return np.unique(np.array([of(joined[s:e], SEED) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], "<u8"))


def profile(text: str | None, size: int) -> tuple[int, list[int], bytes, bytes, int, int]:
    """(fingerprint, shard keys, 16 bits of each min-hash, least shingle hashes, different shingles, hash of all of them) of a text."""
    hashes = shingle_hashes(text, size)  # repeats count once, as in the similarity
    if not (n := len(hashes)):
        return 0, [0] * KEYS, bytes(2 * HASHES), b"", 0, 0
    set_bits, least = np.zeros(BITS, np.int64), np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, n, _PART):
        some = hashes[at:at + _PART]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        least = np.minimum(least, (some[:, None] * _MIX[0] + _MIX[1]).min(0))
    print_ = int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])
    kept, whole = hashes[:KEPT], xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)
    return print_, least[:KEYS].view("<i8").tolist(), (least >> np.uint64(32)).astype("<u2").tobytes(), (kept >> np.uint64(32)).astype("<u4").tobytes(), n, whole


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            made = [profile(t, size) for t in texts_of(batch, "text")]
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "row_", "fingerprint", "keys", "signature", "shingles", "n", "whole"])

    return run


def verdict(a: frozenset, b: frozenset, cut: bool, similarity: float) -> bool | None:
    """Whether two shingle sets are as similar as that; None if they are cut and their least hashes don't say."""
    if not a and not b:
        return True
    both = a & b
    if not cut:
        return len(both) / (len(a) + len(b) - len(both)) >= similarity
    least = sorted(a | b)[:KEPT]
    above = sum(x in both for x in least) / len(least) - similarity
    return None if abs(above) <= DEVIATIONS * (similarity * (1 - similarity) / len(least)) ** 0.5 else above > 0


def _stars(shard: np.ndarray, rows: dict, in_tree: np.ndarray, searches: np.ndarray, similarity: float) -> pa.RecordBatch | None:
    trees, asked = np.flatnonzero(in_tree), np.flatnonzero(searches)
    if not (trees.size and asked.size):
        return None
    forest, label = Forest(shard[trees], rows["prints"][trees]), np.arange(len(shard))
    signs, shingles, whole, sets, unsure = rows["signs"], rows["shingles"], rows["n"], {}, []

    def set_of(i: int) -> frozenset:
        if i not in sets:
            if len(sets) >= SETS:
                sets.clear()
            sets[i] = frozenset(np.frombuffer(shingles[i], "<u4").tolist())
        return sets[i]

    for at in range(0, len(asked), SEARCHES):
        some = asked[at:at + SEARCHES]
        query, node = forest.search(shard[some], rows["prints"][some], radius_of(similarity))
        a, b = some[query], trees[node]
        # sets of too different sizes are not as similar as that
        open_ = (a != b) & (label[a] != label[b]) & (np.minimum(whole[a], whole[b]) >= similarity * np.maximum(whole[a], whole[b]) - 1e-6)
        a, b = a[open_], b[open_]
        alike = np.empty(len(a), bool)
        for s in range(0, len(a), _PART):
            e = s + _PART
            alike[s:e] = (signs[a[s:e]] == signs[b[s:e]]).mean(1) >= least_equal(similarity)
        a, b = a[alike], b[alike]
        while a.size:
            _, first = np.unique(a, return_index=True)
            said = [verdict(set_of(u), set_of(v), max(whole[u], whole[v]) > KEPT, similarity) for u, v in zip(a[first].tolist(), b[first].tolist(), strict=True)]
            near = [i for i, is_near in zip(first.tolist(), said, strict=True) if is_near]
            unsure += [(int(a[i]), int(b[i])) for i, is_near in zip(first.tolist(), said, strict=True) if is_near is None]
            if near:
                _merge(label, a[near], b[near])
            left = np.ones(len(a), bool)
            left[first] = False
            left &= label[a] != label[b]
            a, b = a[left], b[left]
    far = np.flatnonzero(label != np.arange(len(label)))
    # each once, and only between groups that are still apart
    pair = np.unique(np.sort(np.array(unsure, np.int64).reshape(-1, 2), axis=1), axis=0)
    pair = pair[label[pair[:, 0]] != label[pair[:, 1]]]
    if not (far.size or len(pair)):
        return None
    u, v = np.concatenate([far, pair[:, 0]]), np.concatenate([label[far], pair[:, 1]])
    return pa.RecordBatch.from_pydict({"u": rows["nodes"][u], "v": rows["nodes"][v], "sure": np.arange(len(u)) < len(far)})


_GROUP = ["p", "s", "tree", "asks"]


def _search(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(rows: pa.Table):
            column = lambda c: rows.column(c).to_numpy()
            keys = np.stack([column(c) for c in _GROUP], 1)
            shard = np.concatenate([[0], np.cumsum(np.any(keys[1:] != keys[:-1], axis=1))])
            part = column("part")
            data = {"prints": column("fingerprint"), "nodes": column("node"), "n": column("n"), "shingles": rows.column("shingles").to_pylist(),
                    "signs": np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)}
            return _stars(shard, data, part == keys[:, 2], part == keys[:, 3], similarity)

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= ROWS:
                keys = np.stack([held.column(c).to_numpy() for c in _GROUP], 1)
                cut = int(np.argmax(np.all(keys == keys[-1], axis=1)))  # rows are sorted: the last group begins here
                if cut:
                    if (out := flush(held.slice(0, cut))) is not None:
                        yield out
                    held = held.slice(cut)
        if held is not None and (out := flush(held)) is not None:
            yield out

    return run


def near_copies(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, sure): links that connect near-copies, and pairs not sure to be, from (node, fingerprint, keys, signature, shingles, n).

    Equal nodes have equal rows.
    """
    first = lambda *columns: nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in columns])
    rows = first("keys").select("node", F.posexplode("keys").alias("p", "s")).select(F.col("p").cast("long"), "s", "node")
    sizes = rows.groupBy("p", "s").agg(F.count("*").alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / LARGE).cast("long")
    met = rows.join(sizes, ["p", "s"]).select("p", "s", "node", F.pmod(F.xxhash64("node"), cut).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("other"))
    dealt = met.select("p", "s", F.least("part", "other").alias("tree"), F.greatest("part", "other").alias("asks"), "part", "node")
    # shards are found on narrow rows; the shingles are dealt by node once, for both the grouping and this join
    full = dealt.join(first("fingerprint", "signature", "shingles", "n"), "node")
    return full.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node").mapInArrow(_search(similarity), "u long, v long, sure boolean")


def _slices(size: int):
    """(node, cut, slice, hashes) of the whole sets of texts: slices by the leading ``cut`` bits of the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, cut, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = shingle_hashes(text, size)
                of = (hashes >> np.uint64(64 - cut)).astype(np.int64) if cut else np.zeros(len(hashes), np.int64)
                which, at = np.unique(of, return_index=True)
                ends = pa.array([*at.tolist(), len(hashes)], pa.int32())
                same = lambda value: pa.array(np.full(len(which), value, np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(node), same(cut), pa.array(which), pa.ListArray.from_arrays(ends, pa.array(hashes.view("<i8")))], ["node", "cut", "slice", "hashes"])

    return run


def settled(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, v): those pairs that are as similar as that, by what their whole sets share.

    ``texts`` has (node, text) and ``sizes`` (node, n), each node once. Sets are cut to slices of about ``SLICE`` hashes by the pair's larger set, so that no
    row grows with a text's length.
    """
    n = lambda name: sizes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = pairs.select("u", "v").distinct().join(n("u"), "u").join(n("v"), "v")
    cut = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("n_u", "n_v") / F.lit(SLICE)))).cast("long")
    pairs = stage(pairs.withColumn("cut", cut), "unsure")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node"), "cut").distinct()
    sliced = stage(wanted.join(texts, "node").select("node", "cut", "text").mapInArrow(_slices(size), "node long, cut long, slice long, hashes array<long>"), "slices")
    side = lambda name: sliced.select(F.col("node").alias(name), "cut", "slice", F.col("hashes").alias(f"h_{name}"))
    both = F.sum(F.size(F.array_intersect("h_u", "h_v"))).alias("both")
    shared = pairs.join(side("u"), ["u", "cut"]).join(side("v"), ["v", "cut", "slice"]).groupBy("u", "v", "n_u", "n_v").agg(both)
    return shared.where(F.col("both") / (F.col("n_u") + F.col("n_v") - F.col("both")) >= similarity).select("u", "v")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near-copies: of each group the row with the smallest id, as it is."""
    keyed = docs.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(*docs.columns).alias("row_"))
    kind = "doc_id long, row_ long, fingerprint long, keys array<long>, signature binary, shingles binary, n long, whole long"
    made = keyed.select("doc_id", "row_", "text").mapInArrow(_profiles(size), kind)
    made = stage(made.withColumn("node", F.xxhash64("n", "whole", "fingerprint")).drop("whole"), "profiles")
    # texts of equal sets are one node from the start
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_")
    least = stage(made.groupBy("node").agg(F.min(order).alias("o"), F.first("n").alias("n")), "least")
    found = stage(near_copies(made, similarity), "stars")
    links, unsure = found.where("sure").select("u", "v"), found.where("not sure")
    if not unsure.isEmpty():
        named = unsure.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(least, "node").select("node", F.col("o.doc_id").alias("id_"), F.col("o.row_").alias("r_"))
        same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("row_") == F.col("r_"))
        texts = keyed.join(named, same).select("node", "text").dropDuplicates(["node"])
        links = links.union(settled(unsure, texts, least.select("node", "n"), size, similarity))
    roots = components(links).withColumnRenamed("node", "node_")
    stay = (least.join(roots, F.col("node") == F.col("node_"), "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("o").alias("o")).select(F.col("o.doc_id").alias("id_"), F.col("o.row_").alias("r_")))
    first = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("row_") == F.col("r_")), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "row_").orderBy("row_"))
    return first.withColumn("place_", place).where("place_ = 1").select("document.*")
