"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of at most ``order`` bytes with the counts seen after each. The code length of
a byte is the negative log of its probability in the longest context that exists, and what a context never saw is reached
through its escape (method C: escape weight = number of different bytes seen), with the seen bytes excluded below. As the
statistics are frozen after fitting, a byte's code length depends on its last ``order`` bytes only, so all of them are
computed once per (context, byte) and whole texts are scored by array lookups. The language with the shortest code wins.

Fitting reads a bounded sample: about ``per_language`` documents of each language, the ones with the smallest hash of
their id. Counting runs in Spark; only the counts reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Equal code lengths go to the language
that sorts first. Rows are scored one by one, so repeated rows get the same answer each. No labelled row: every text is
``und``. A null id is never learned from and counts as held out. Other columns are ignored by ``predict`` and kept as
they are by ``known_languages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import crc_of, table, texts_of
from corpusloom.session import ship

UNKNOWN = "und"
ORDER = 3
#: Documents of a language that are counted, about; a random sample by hash, as their number is known beforehand.
PER_LANGUAGE = 300
#: A context of three bytes is kept if it was seen so often over all languages, a bound for the tree.
LEAST_SEEN = 2
#: Most languages, and most bytes of the tree's table, that are broadcast.
MOST_LANGUAGES, MOST_TABLE = 1000, 512 << 20
#: Fence on bits a byte: steps a bit of the counts, distances of the middle half above it, the least such distance, what short texts may add.
STEPS, REACH, SPREAD, SHORT = 32, 8, 0.25, 40.0
#: Bytes scored at once.
BLOCK = 1 << 19
_START = b"   "


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang) of about so many labelled documents per language, spread by the hash of the id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / count)).otherwise(share)
    # the upper bits of one hash, as a number from 0 to 1
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return labelled.where(drawn < share).select("text", "lang")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {}
        for text, lang in zip(texts_of(batch, "text"), texts_of(batch, "lang"), strict=True):
            raw = np.frombuffer(_START + text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int64)
            if raw.size > ORDER:
                found.setdefault(lang, []).append(raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:])
        for lang, grams in found.items():
            values, counts = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": counts.astype(np.int64)})


class ContextTrees:
    """Code lengths in bits of every byte after every kept context, for all languages at once."""

    def __init__(self, grams: pd.DataFrame):
        self.languages = sorted(grams["lang"].unique()) if len(grams) else []
        if not self.languages:
            return
        lang = grams["lang"].map({x: i for i, x in enumerate(self.languages)}).to_numpy(np.int64)
        gram, n = grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
        bytes_of = [(gram >> s & 255) for s in (24, 16, 8, 0)]
        alphabet = np.unique(np.concatenate([np.unique(b) for b in bytes_of] + [[32]]))
        self.classes = np.zeros(256, np.int32)
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        size, langs = len(alphabet) + 1, len(self.languages)
        self.size = size
        c = [self.classes[b].astype(np.int64) for b in bytes_of]

        def refined(context: np.ndarray, nodes: np.ndarray, below: np.ndarray) -> np.ndarray:
            """Probabilities [node, byte, language] of the contexts ``nodes``, with ``below`` those one byte shorter."""
            at = np.searchsorted(nodes, context)
            ok = nodes[np.minimum(at, len(nodes) - 1)] == context
            seen = np.zeros((len(nodes), size, langs), np.float32)
            np.add.at(seen, (at[ok], c[3][ok], lang[ok]), n[ok])
            total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            left = np.where(seen > 0, 0, below).sum(1, keepdims=True)
            escape = np.where(left > 1e-7, kinds, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                known = seen / (total + escape)
                rest = below * (escape / (total + escape)) / np.maximum(left, 1e-7)
            return np.where(total == 0, below, np.where(seen > 0, known, np.where(escape > 0, rest, 1e-7))).astype(np.float32)

        flat = np.full((1, size, langs), 1 / 256, np.float32)
        flat[:, 0] = (256 - len(alphabet)) / 256
        zero = refined(np.zeros(len(gram), np.int64), np.zeros(1, np.int64), flat)
        ones = np.arange(size, dtype=np.int64)
        one = refined(c[2], ones, np.repeat(zero, size, 0))
        context2 = c[1] * size + c[2]
        twos = np.unique(context2)
        two = refined(context2, twos, one[twos % size])
        context3 = c[0] * size * size + context2
        threes, where = np.unique(context3, return_inverse=True)
        threes = threes[np.bincount(where, n) >= LEAST_SEEN]
        if (len(threes) + len(twos) + size) * size * langs * 4 > MOST_TABLE:
            raise ValueError("the context trees are larger than may be broadcast; take a smaller sample")
        three = refined(context3, threes, two[np.searchsorted(twos, threes % (size * size))])
        # the longest kept context of any three bytes
        longest = np.tile(ones, size * size).astype(np.int32)
        by_two = np.tile(ones, size)
        by_two[twos] = size + np.arange(len(twos))
        longest[:] = np.tile(by_two, size)
        longest[threes] = size + len(twos) + np.arange(len(threes))
        self.longest = longest
        bits = -np.log2(np.concatenate([one, two, three]))
        bits[:, 0] += np.log2(max(1, 256 - len(alphabet)))
        self.bits = np.ascontiguousarray(bits.reshape(-1, langs), np.float32)

    def lengths(self, raw: bytes) -> np.ndarray:
        """Bits of a text's bytes under each language."""
        return self.batch_lengths([raw])[0]

    def batch_lengths(self, raws: list[bytes]) -> np.ndarray:
        """The same for many texts, joined to blocks of bounded size."""
        out = np.zeros((len(raws), len(self.languages)))
        held: list[tuple[int, bytes]] = []
        room = 0
        for i, raw in enumerate(raws):
            for start in range(0, len(raw), BLOCK):
                before = (_START + raw[max(0, start - ORDER):start])[-ORDER:]
                piece = before + raw[start:start + BLOCK]
                held.append((i, piece))
                room += len(piece)
                if room >= BLOCK:
                    self._add(held, out)
                    held, room = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes]], out: np.ndarray) -> None:
        c = self.classes[np.frombuffer(b"".join(p for _, p in held), np.uint8)]
        node = self.longest[(c[:-3] * self.size + c[1:-2]) * self.size + c[2:-1]]
        rows = np.zeros((len(node) + 1, self.bits.shape[1]), np.float32)
        np.take(self.bits, node.astype(np.int64) * self.size + c[3:], axis=0, out=rows[:-1])
        ends = np.cumsum([len(p) for _, p in held])
        starts = ends - [len(p) for _, p in held]
        # a piece of k bytes after its context has k - 3 code lengths; the three that follow span two pieces
        sums = np.add.reduceat(rows, np.stack([starts, ends - ORDER], 1).ravel(), axis=0, dtype=np.float64)[::2]
        np.add.at(out, [i for i, _ in held], sums)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ContextTrees:
    """Context trees from a bounded sample of the rows with a language."""
    counted = (sample(docs, per_language).mapInArrow(_gram_counts, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return ContextTrees(counted.toPandas())


def answers(trees: ContextTrees, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
    """Language, share of its likelihood in that of all, and bits per byte, for each text."""
    chosen = [i for i, t in enumerate(texts) if t is not None and trees.languages and any(map(str.isalpha, t))]
    langs, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
    raws = [texts[i].lower().encode("utf-8", "replace") for i in chosen]
    if raws:
        bits = trees.batch_lengths(raws)
        best = bits.argmin(1)
        least = bits[np.arange(len(best)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        for k, i in enumerate(chosen):
            langs[i], scores[i], rates[i] = trees.languages[best[k]], float(share[k]), float(least[k] / len(raws[k]))
    return langs, scores, rates


def predict(docs: DataFrame, trees: ContextTrees, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, bits_per_byte) of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rates = answers(shared.value, texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                                             ["key", "lang_pred", "score", "bits_per_byte"])

    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                         T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, kind).withColumnRenamed("key", key)


def fences(docs: DataFrame, trees: ContextTrees) -> dict[str, float]:
    """Most bits a byte of a language's texts: from counts of the labelled texts' code lengths, which merge by addition.

    The fence stands ``REACH`` times the distance of the middle half above it, and at least ``REACH * SPREAD`` bits.
    """
    found = predict(docs.where("lang is not null and text is not null"), trees).where("bits_per_byte is not null")
    counts = found.groupBy("lang_pred", F.floor(F.col("bits_per_byte") * STEPS).alias("step")).agg(F.count("*").alias("n")).toPandas()
    out = {}
    for lang, rows in counts.groupby("lang_pred"):
        rows = rows.sort_values("step")
        share = rows["n"].cumsum() / rows["n"].sum()
        low, high = (rows["step"][share >= q].iloc[0] / STEPS for q in (0.25, 0.75))
        out[lang] = float(high + REACH * max(high - low, SPREAD))
    return out


def known_languages(docs: DataFrame, trees: ContextTrees, fence: dict[str, float] | None = None, least_score: float = 0.5) -> DataFrame:
    """The rows whose language is known, as they are.

    Texts without letters or without a clear language go, and those that the best language's trees code in far more bits a byte
    than its own texts: other languages and random letters. A short text may lie above the fence by ``SHORT`` bits over the root of its bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((trees, fences(docs, trees) if fence is None else fence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, most = shared.value
        for batch in batches:
            texts = texts_of(batch, "text")
            rows = zip(texts, *answers(trees, texts), strict=True)
            kept = [lang != UNKNOWN and score >= least_score and bits <= most.get(lang, np.inf) + SHORT / len(text.encode("utf-8", "replace")) ** 0.5
                    for text, lang, score, bits in rows]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """Documents never learned from: the checksum of the id's text divides by five."""
    return F.coalesce(crc_of(F.col(key)) % 5 == 0, F.lit(True))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labels."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.where(~held_out()))
    return predict(docs, trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
