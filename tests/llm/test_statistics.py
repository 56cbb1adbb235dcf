"""Phrases, whitening and quality scores against brute force, and over odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import additive, phrases, whitening
from corpusloom.llm.common import table
from corpusloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_phrases(rows, depth, least, covered, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            inside = any(100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items() if len(q) > len(p))
            if not inside:
                score, k, left, right = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def found_phrases(docs, **options):
    return sorted(map(tuple, phrases.collocations(docs, **options).select(COLUMNS).collect()))


@pytest.fixture(scope="module")
def wordy():
    rng = random.Random(5)
    words = ["the", "The", "a", "b", "ä", "é-", "x\x01", "x", " ", "long" * 30, "\x00", "don't", "Ä"]
    rows = [("en", None), (None, ""), ("en", " \t."), ("de", "one"), (None, "the a the a " * 200), ("en", "the " * 3000), ("", "a b, a b; a b\x0ba b\x0ca b")]
    rows += [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(90)))) for _ in range(150)]
    return rows


@pytest.mark.parametrize("options", [{}, {"budget": 40, "size": 300}, {"budget": 1, "size": 1}, {"depth": 2}, {"depth": 4, "least": 3, "budget": 200, "size": 1000}, {"top": 3, "covered": 90}])
def test_phrases_equal_brute_force(spark, wordy, options):
    docs = spark.createDataFrame(wordy, "lang string, text string").repartition(3)
    settings = {"depth": 3, "least": 10, "covered": 50, "top": 2000} | {k: v for k, v in options.items() if k not in ("budget", "size")}
    assert found_phrases(docs, **options) == brute_phrases(wordy, **settings)


def test_phrases_of_given_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute_phrases(rows, 3, 10, 50, 2000)
    assert found_phrases(docs) == want == found_phrases(docs, budget=500, size=5000)


def test_phrase_numbers_past_64_bits(spark):
    known = spark.createDataFrame([("en", "a", 4 * 10 ** 12), ("en", "b", 3 * 10 ** 12), ("en", "a b", 2 * 10 ** 12)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 10 ** 13)], "lang string, total long")
    real, phrases.frequencies = phrases.frequencies, lambda *_: (known, totals)
    try:
        assert found_phrases(known) == [("en", 1, "a b", 2 * 10 ** 12, 4 * 10 ** 12, 3 * 10 ** 12, 10 ** 13, 333333)]
    finally:
        phrases.frequencies = real


def test_phrases_odd_rows(spark, edge_docs, edge_rows, no_docs):
    assert found_phrases(edge_docs) == brute_phrases([(r[2], r[1]) for r in edge_rows], 3, 10, 50, 2000)
    assert found_phrases(no_docs) == []


def test_long_texts_are_cut_between_words():
    text = (b"ab cd. " * 100 + b"x" * 500 + b" y z w" * 50)
    chunks = list(phrases._chunks(text, 64, 3))
    whole = phrases.Suffixes(text, len(text), 3)
    want = Counter(zip(*([whole.words[i].as_py() if i >= 0 else None for i in c] for c in whole.columns), strict=True))
    got = Counter()
    for chunk, own in chunks:
        tree = phrases.Suffixes(chunk, own, 3)
        got.update(zip(*([tree.words[i].as_py() if i >= 0 else None for i in c] for c in tree.columns), strict=True))
    assert got == want and b"".join(c[:own] for c, own in chunks) == text


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n = len(x)
    centred = (n * x - x.sum(0)) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-13 * e[0]).sum()))
    return centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), [sum(int(t) ** 2 for t in row) for row in (n * x.astype(object) - x.sum(0))]


def rows_of(found):
    rows = sorted(found.collect(), key=lambda r: (r.vec_id, r.component))
    return rows, len({r.component for r in rows})


@pytest.mark.parametrize("kind", ["plain", "far", "nearly flat", "fewer rows", "copied", "constant"])
def test_whitening_equals_eigenvectors(spark, kind):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 12)) * np.arange(1, 13)
    if kind == "far":
        vectors += 50_000
    if kind == "nearly flat":
        vectors[:, 3] = vectors[:, 4] + rng.integers(0, 2, 300) / 1024
    if kind == "fewer rows":
        vectors = vectors[:6]
    if kind == "copied":
        vectors[:, 5] = vectors[:, 6]
    if kind == "constant":
        vectors[:, 7] = 3.5
    data = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    rows, k = rows_of(whitening.whiten(data, 12))
    want, explained, deviations = brute_whitening(vectors, 12)
    assert k == want.shape[1] and len(rows) == len(vectors) * k
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    # components of the smallest eigenvalues are compared up to what the brute covariance itself resolves
    assert np.allclose(np.abs((got * want).mean(0)), 1, atol=1e-5) and np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-4)
    assert rows[0].identity_error < 1e-6 and [r.deviation for r in rows[::k]] == deviations


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], [3.0, -1.0, 2.0], [3.0, -1.0, 2.0], [-1.0, 4.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i if i != 4 else None, v, "x", "y") for i, v in enumerate(good)] + [(2, good[0], None, None)] + [(100 + i, v, "x", "y") for i, v in enumerate(bad)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n string")
    found = whitening.whiten(data).collect()
    want, explained, deviations = brute_whitening([*good, good[0]])
    assert Counter(r.vec_id for r in found) == {0: 3, 1: 3, 2: 6, 3: 3, None: 3} and {r.n for r in found} == {6}
    assert Counter(r.deviation for r in found) == Counter(d for d in deviations for _ in range(3))
    for none in (data.where("vec_id = 0"), data.where("vec_id is null and false"), data.where("vec_id >= 100 and vec_id < 106"), data.where("vec_id in (2, 3) and component is not null")):
        assert whitening.whiten(none).count() == 0
    assert whitening.whiten(data.where("vec_id >= 100")).schema == whitening.whiten(data.where("false")).schema


def test_deviation_past_64_bits():
    of = whitening.Moments(10 ** 9, [10 ** 15, 3])
    whole = np.array([[5 * 10 ** 8, 7], [1, 2]], np.int64)
    assert of.deviations(whole) == [sum((10 ** 9 * int(x) - s) ** 2 for x, s in zip(row, of.sums)) for row in whole]


def test_triangular_solve():
    rng = np.random.default_rng(1)
    upper, rows = np.triu(rng.standard_normal((9, 9))) + 5 * np.eye(9), rng.standard_normal((20, 9))
    assert np.allclose(whitening.solved(rows, upper) @ upper, rows)


def brute_counts(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    windows = [words[i:i + additive.WINDOW] for i in range(0, len(words), additive.WINDOW)]
    pairs = [((i // additive.WINDOW), words[i], words[i + 1]) for i in range(len(words) - 1)]
    of = lambda members: sum(b in members for b in text)
    return {"upper": of(bytes(range(65, 91))), "digit": of(b"0123456789"), "symbol": of(b"#*$%&|<>"), "bar": of(b"|"), "exclaim": of(b"!"), "words": len(words),
            "bytes": sum(map(len, words)), "squares": sum(len(w) ** 2 for w in words), "short": sum(len(w) <= 3 for w in words), "different": sum(len(set(w)) for w in windows),
            "different_pairs": len(set(pairs)), "stuttered": sum(a == b for a, b in zip(words, words[1:])), "lines": len(lines), "new_lines": len(set(lines)),
            "titled": sum(65 <= w[0] <= 90 for w in words), "marked": sum(w[-1] in b"#*$%&|<>" for w in words)}


def test_quality_measures_equal_brute_force():
    rng = random.Random(2)
    texts = [b"", b" \n\t", b"a", b"a a a", "É é\nÉ é\n \nx|".encode(), b"\n\nA!! B!!\n", b"w " * 700]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "x#", "\n", "12"]) for _ in range(rng.randrange(600))).encode() for _ in range(12)]
    rows = additive.measured(texts)
    for text, row in zip(texts, rows, strict=True):
        want = brute_counts(text)
        assert {name: row[additive._COUNTS.index(name)] for name in want} == want
    assert np.allclose(np.concatenate([additive.measured([t]) for t in texts]), rows) and np.isfinite(additive.shaped(rows)).all()


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    found = QUERIES["op13_quality_scores"](spark, base).join(table(spark, base, "labels"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and found.score.between(0, 1).all()
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98


def test_quality_model_is_a_sum_of_tables():
    rng = np.random.default_rng(4)
    values = rng.standard_normal((4000, 5)).round(2)
    # the first feature alone, and the second and third only together, decide
    good = ((values[:, 0] > 0.5) ^ (values[:, 1] * values[:, 2] > 0)).astype(float)
    edges = [np.unique(np.quantile(v, np.arange(1, 32) / 32)) for v in values.T]
    model = additive.boosted(values[:3000], good[:3000], edges)
    scores = model.scores(values[3000:])
    assert (2, 1) in model.pairs and len(model.tables) == 5
    plain = additive.boosted(values[:3000], good[:3000], edges, pairs=0).scores(values[3000:])
    loss = lambda p: -np.log(np.where(good[3000:] > 0, p, 1 - p)).mean()
    assert loss(scores) < loss(plain) - 0.02
    for row, score in zip(values[3000:3050], scores, strict=False):
        at = [int((e <= x).sum()) for e, x in zip(edges, row, strict=True)]
        total = model.intercept + sum(t[i] for t, i in zip(model.tables, at, strict=True))
        total += sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_shallow_trees():
    g, h = np.array([5.0, 5, -5, -5, 4]), np.full(5, 10.0)
    assert np.allclose(additive.grown(g, h), [10 / 21, 10 / 21, -10 / 21, -10 / 21, 4 / 11])
    gain, cells = additive.quadrants(np.array([[5.0, -5], [-5, 5]]), np.full((2, 2), 10.0))
    assert gain > 0 and np.allclose(cells, np.array([[5, -5], [-5, 5]]) / 11)
    assert not additive.grown(np.ones(1), np.ones(1)).any() and additive.quadrants(np.ones((1, 3)), np.ones((1, 3)))[0] == 0


def test_quality_odd_rows(spark, edge_docs, no_docs, monkeypatch):
    labels = spark.createDataFrame([(10, 1), (11, 1), (12, 0), (12, 0), (12, 1), (30, 0), (None, 1), (31, None), (999, 1), (5, 0)], "doc_id long, quality int")
    measures = additive.features(edge_docs)
    model = additive.fit(measures, labels)
    found = additive.scored(measures, model).collect()
    assert len(found) == edge_docs.count() and all(0 <= r.score <= 1 for r in found)
    empty = {r.doc_id: r.features for r in measures.collect() if r.doc_id in (1, 2, 3)}
    assert set(empty) == {1, 2, 3} and not any(any(f) for f in empty.values())
    nothing = additive.fit(additive.features(no_docs), labels)
    assert {r.score for r in additive.scored(measures, nothing).collect()} == {0.5} and additive.scored(additive.features(no_docs), model).count() == 0
    unlabelled = additive.fit(measures, labels.where("false"))
    assert {r.score for r in additive.scored(measures, unlabelled).collect()} == {0.5}
    whole = {r.features[0] for r in measures.where("doc_id = 4").collect()}
    monkeypatch.setattr(additive, "STRETCH", 1000)
    rows = list(additive._stretches(b"ab cd\n" * 900))
    assert len(rows) > 4 and b"".join(rows) == b"ab cd\n" * 900 and whole
