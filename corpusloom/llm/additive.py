"""Quality scores from a generalised additive model with pairwise interactions.

A text is measured by some twenty numbers (word shapes, repetition, lines, marks). Each number is cut to bins at quantiles,
and boosting goes through the features in turn, again and again: a shallow tree on one feature's bins moves that feature's
lookup table a small step. When validation stops getting better, the pairs whose best quadrants still explain most are
boosted the same way on coarse bins. A score is the sum of one table entry per feature and pair, through the logistic
function: additions over arrays, no tree is walked.

Measuring reads every text once and whole, in Spark; the numbers are written to the shared folder. Quantiles are mergeable
sketches over all documents that may be learned from. The tables are fitted on about ``FIT_ROWS`` labelled documents, a
random share by hash of the id, on the driver: some twenty bin numbers a document, of a number that does not grow.

Defined results: a null or empty text has zero in every measure and is scored like any other. Texts over ``STRETCH`` bytes are
measured in stretches cut between words, whose counts add up. A label whose id or quality is null is not used; of several for
one id the mean decides, and half counts as good. A null id is never learned from. Without a label every score is 0.5.
Rows are scored one by one, so repeated rows get the same score each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of, table
from corpusloom.session import ship
from corpusloom.storage import stage

FEATURES = ("words", "word_length", "word_spread", "short_words", "different_words", "different_pairs", "stuttered_words",
            "repeated_lines", "capitals", "symbols", "bars", "exclamations", "sentence_marks", "commas", "digits", "beyond_ascii",
            "line_words", "capitalised_words", "marked_words")
FIT_ROWS, QUANTILES, COARSE, PAIRS = 20_000, 64, 8, 8
STEP, ROUNDS, PATIENCE, LEAST_WEIGHT, DAMPING = 0.1, 400, 25, 2.0, 1.0
#: Smallest score that is predicted as good.
GOOD = 0.3
#: Words of a window in which repetition is counted; bytes measured at once.
WINDOW, STRETCH = 256, 8 << 20

_LETTERS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>",
            "bar": b"|", "exclaim": b"!", "sentence": b".!?", "comma": b",;:"}
_SPACE = np.zeros(256, bool)
_SPACE[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = True
_CLASS = {name: np.isin(np.arange(256), list(members)) for name, members in _LETTERS.items()}
_CLASS["beyond"] = np.arange(256) >= 0xC0
_CLASS["word"] = ~_SPACE
_COUNTS = (*_CLASS, "words", "bytes", "squares", "short", "different", "different_pairs", "stuttered", "lines", "new_lines", "titled", "marked")
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, equal for equal bytes."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[inside])])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def measured(texts: list[bytes]) -> np.ndarray:
    """Counts of each text, a row for each; the texts are measured together, so they should be of bounded size."""
    block = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(block, np.uint8)
    n = len(texts)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1].astype(np.int64)
    out = {name: np.add.reduceat(member[raw].view(np.int8), first, dtype=np.int64) for name, member in _CLASS.items()}
    per = lambda where, weights=None: np.bincount(where, weights, n)
    starts, ends = _spans(~_SPACE[raw])
    doc = np.searchsorted(first, starts, "right") - 1
    length = ends - starts
    out["words"], out["bytes"], out["squares"] = per(doc), per(doc, length), per(doc, length.astype(float) ** 2)
    out["short"] = per(doc[length <= 3])
    word = _numbers(raw, starts, ends)
    begin = np.concatenate([[0], np.cumsum(out["words"].astype(np.int64))])[:-1]
    window = (np.arange(len(word)) - begin[doc]) // WINDOW
    size = int(word.max(initial=0)) + 1
    place = doc * (int(window.max(initial=0)) + 1) + window

    def different(values: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
        _, seen = np.unique(np.unique(at, return_inverse=True)[1] * top + values, return_index=True)
        return seen

    out["different"] = per(doc[different(word, place, size)])
    joined = np.flatnonzero(doc[1:] == doc[:-1])
    _, pair = np.unique(word[joined] * size + word[joined + 1], return_inverse=True)
    out["different_pairs"] = per(doc[joined][different(pair, place[joined], int(pair.max(initial=0)) + 1)])
    out["stuttered"] = per(doc[joined][word[joined] == word[joined + 1]])
    out["titled"] = per(doc[_CLASS["upper"][raw[starts]]])
    out["marked"] = per(doc[_CLASS["symbol"][raw[ends - 1]]])
    line_starts, line_ends = _spans(raw != 10)
    filled = np.concatenate([[0], np.cumsum(~_SPACE[raw])])
    some = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[some], line_ends[some]
    line_doc = np.searchsorted(first, line_starts, "right") - 1
    line = _numbers(raw, line_starts, line_ends)
    out["lines"] = per(line_doc)
    out["new_lines"] = per(line_doc[different(line, line_doc, int(line.max(initial=0)) + 1)])
    return np.stack([out[name] for name in _COUNTS], 1).astype(np.float64)


def shaped(counts: np.ndarray) -> np.ndarray:
    """The features of texts from their counts."""
    c = dict(zip(_COUNTS, counts.T, strict=True))
    rate = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    words, mean = c["words"], rate(c["bytes"], c["words"])
    return np.stack([
        np.log1p(words), mean, np.sqrt(np.maximum(rate(c["squares"], words) - mean ** 2, 0)), rate(c["short"], words), rate(c["different"], words),
        rate(c["different_pairs"], words), rate(c["stuttered"], words), rate(c["lines"] - c["new_lines"], c["lines"]), rate(c["upper"], c["upper"] + c["lower"]),
        rate(c["symbol"], words), rate(c["bar"], words), rate(c["exclaim"], words), rate(c["sentence"], words), rate(c["comma"], words),
        rate(c["digit"], c["word"]), rate(c["beyond"], c["word"]), np.log1p(rate(words, c["lines"])), rate(c["titled"], words), rate(c["marked"], words)], 1)


def _stretches(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > STRETCH:
        gap = _GAP.search(text, at + STRETCH)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, features) of every row; only the text is looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = np.zeros((len(texts), len(_COUNTS)))
            held, room = [], 0

            def add(held: list, counts=counts) -> None:
                rows = measured([t for _, t in held])
                np.add.at(counts, [i for i, _ in held], rows)

            for i, text in enumerate(texts):
                for piece in _stretches(text or b""):
                    held.append((i, piece))
                    room += len(piece)
                    if room >= STRETCH:
                        add(held)
                        held, room = [], 0
            if held:
                add(held)
            values = pa.FixedSizeListArray.from_arrays(pa.array(shaped(counts).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["key", "features"])

    kind = f"key {docs.schema[key].dataType.simpleString()}, features array<double>"
    return docs.select(F.col(key).alias("key"), F.col("text").cast("string")).mapInArrow(run, kind).withColumnRenamed("key", key)


def _split(g: np.ndarray, h: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """(gain, cut) of the best cut of the bins a to b into two leaves."""
    if b - a < 2:
        return 0.0, a
    gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
    left_g, left_h, right_g, right_h = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
    gain = left_g ** 2 / (left_h + DAMPING) + right_g ** 2 / (right_h + DAMPING) - gs[-1] ** 2 / (hs[-1] + DAMPING)
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
    best = int(gain.argmax())
    return float(gain[best]), a + best + 1


def grown(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The leaf values, by bin, of a tree of at most three leaves over gradient and weight sums of bins."""
    cuts = [0, len(g)]
    for _ in range(2):
        options = [(*_split(g, h, a, b),) for a, b in zip(cuts, cuts[1:], strict=False)]
        gain, cut = max(options, key=lambda o: o[0])
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, cut])
    out = np.zeros(len(g))
    if len(cuts) > 2:
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + DAMPING)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values by cell) of the best cross of one cut on each axis."""
    def corners(x: np.ndarray) -> np.ndarray:
        below = x.cumsum(0).cumsum(1)
        low = below[:-1, :-1]
        right, left = below[:-1, -1:] - low, below[-1:, :-1] - low
        return np.stack([low, right, left, below[-1, -1] - low - right - left])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corners(g), corners(h)
    gain = (gs ** 2 / (hs + DAMPING)).sum(0)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    values = gs[:, a, b] / (hs[:, a, b] + DAMPING)
    out[:a + 1, :b + 1], out[:a + 1, b + 1:], out[a + 1:, :b + 1], out[a + 1:, b + 1:] = values
    return float(gain[a, b] - g.sum() ** 2 / (h.sum() + DAMPING)), out


@dataclass
class Additive:
    """Lookup tables over bins of features, and over coarse bins of pairs of them."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x, "right") for e, x in zip(self.edges, values.T, strict=True)]

    def logits(self, bins: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(bins[0]) if bins else 0, self.intercept)
        for entries, at in zip(self.tables, bins, strict=False):
            total += entries[at]
        for (i, j), entries in zip(self.pairs, self.pair_tables, strict=True):
            total += entries[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return total

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(values)), -500, 500)))


def boosted(values: np.ndarray, good: np.ndarray, edges: list[np.ndarray], pairs: int = PAIRS) -> Additive:
    """The model of labelled rows; every fifth row, in an order by chance, validates."""
    model = Additive(edges, tables=[np.zeros(len(e) + 1) for e in edges])
    if not len(good):
        return model
    model.intercept = float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1)))
    bins = model.bins(values)
    for at, e in zip(bins, edges, strict=True):
        share = np.cumsum(np.bincount(at, minlength=len(e) + 1)) / len(good)
        # neighbouring bins of about an eighth of the rows each; the first coarse bin begins with the first bin
        model.coarse.append(np.unique(np.minimum(np.concatenate([[0], share[:-1]]) * COARSE, COARSE - 1).astype(int), return_inverse=True)[1])
    check = np.random.default_rng(13).permutation(len(good)) % 5 == 0
    learn = ~check
    logit = np.full(len(good), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.where(learn, good - p, 0), np.where(learn, p * (1 - p), 0)

    def loss() -> float:
        return float(np.logaddexp(0, np.where(good[check] > 0, -1, 1) * logit[check]).mean()) if check.any() else 0.0

    def cycle(tables: list[np.ndarray], cells: list[np.ndarray], grow) -> list[np.ndarray]:
        """Boost the tables in turn until validation stops improving; the best ones."""
        nonlocal logit
        best, kept, kept_logit, since = loss(), [t.copy() for t in tables], logit.copy(), 0
        for _ in range(ROUNDS):
            for entries, at in zip(tables, cells, strict=True):
                g, h = slopes()
                shape = entries.shape
                move = STEP * grow(np.bincount(at, g, entries.size).reshape(shape), np.bincount(at, h, entries.size).reshape(shape))
                entries += move
                logit = logit + move.ravel()[at]
            now = loss()
            since += 1
            if now < best - 1e-6:
                best, kept, kept_logit, since = now, [t.copy() for t in tables], logit.copy(), 0
            if since > PATIENCE:
                break
        logit = kept_logit
        return kept

    model.tables = cycle(model.tables, bins, grown)
    g, h = slopes()
    sizes = [int(c.max()) + 1 for c in model.coarse]
    ranked = []
    for i in range(len(edges)):
        for j in range(i):
            cell, shape = model.coarse[i][bins[i]] * sizes[j] + model.coarse[j][bins[j]], (sizes[i], sizes[j])
            sums = [np.bincount(cell, x, sizes[i] * sizes[j]).reshape(shape) for x in (g, h)]
            ranked.append((-quadrants(*sums)[0], i, j, cell))
    chosen = sorted(ranked, key=lambda r: r[:3])[:pairs]
    model.pairs = [(i, j) for _, i, j, _ in chosen]
    model.pair_tables = cycle([np.zeros((sizes[i], sizes[j])) for i, j in model.pairs], [cell for *_, cell in chosen], lambda a, b: quadrants(a, b)[1])
    return model


def fit(measures: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """The model of (doc_id, features) and (doc_id, quality); quantiles of all rows, tables of about ``fit_rows`` labelled ones."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    shares = [k / QUANTILES for k in range(1, QUANTILES)] + [0.002, 0.005, 0.995, 0.998]
    sketch = measures.agg(*(F.percentile_approx(F.col("features")[i], sorted(shares), 10_000).alias(name) for i, name in enumerate(FEATURES))).first()
    # a bin begins just above a quantile, so rows that share the most frequent value stand alone
    edges = [np.nextafter(np.unique(sketch[name] or []).astype(float), np.inf) for name in FEATURES]
    known = stage(measures.join(usable, "doc_id").select("doc_id", "features", "good"), "labelled")
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    rows = known.where(drawn < share).orderBy("doc_id", "features").select("features", "good").toArrow()
    values = np.array(rows.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return boosted(values, rows.column("good").to_numpy(), edges)


def scored(measures: DataFrame, model: Additive, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of measures."""
    shared = measures.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(values))], ["key", "score"])

    kind = f"key {measures.schema[key].dataType.simpleString()}, score double"
    return measures.select(F.col(key).alias("key"), "features").mapInArrow(run, kind).withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    """Documents never learned from: the checksum of the id's text divides by five."""
    return F.coalesce(crc_of(F.col(key)) % 5 == 0, F.lit(True))


def op13_quality_scores(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from four fifths of the labels."""
    ship(spark)
    measures = stage(features(table(spark, sf_dir, "documents")), "features")
    model = fit(measures.where(~held_out()), table(spark, sf_dir, "labels"))
    return scored(measures, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
