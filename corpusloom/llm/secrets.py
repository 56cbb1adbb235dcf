"""Secrets in texts: fixed patterns, and strings whose characters look random.

A candidate is a run of 20 or more characters of tokens. Over its parts in each character class (hex digits, base64
letters, small letters or capitals with digits) a window of 20 characters slides; its Shannon entropy follows from counts that change by one character in and
one out. Windows at or above the class's threshold that mix the kinds of characters a random string would have are
joined to spans, and a span is then drawn out over the rest of its run: windows at a key's edge may lack a kind of character,
but its characters belong to it. It ends before parts that read as a word or a short number between dashes, underscores and
slashes. Letters alone are a class of their own: both cases must be frequent in a window, more than in names. Strings that are known to be public (empty digests, alphabets, UUIDs, paths of words, words with numbers) are suppressed.

Offsets are code points, ends exclusive. Of a span found by entropy, what patterns cover is taken off, as the
pattern's stays; the rest stays too. Defined results: a null or empty text has no span. Repeated rows are scanned each; other columns are
ignored by ``scan`` and kept by ``redact``, which replaces spans and sets n_chars where that column has a value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import table, texts_of
from corpusloom.session import ship

#: The base patterns in their order, and the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Window of the entropy search, and what may be a candidate.
WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Class: its runs, bits per character that a window needs, and kinds of characters that it must mix.
CLASSES = (
    (re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 3.0, (str.isdigit, str.isalpha)),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7, (str.isdigit, str.islower, str.isupper)),
    (re.compile(r"[a-z0-9]{20,}"), 3.3, (str.isdigit, str.islower)),
    (re.compile(r"[A-Z0-9]{20,}"), 3.2, (str.isdigit, str.isupper)),
)
#: Letters alone: bits a window needs, and how many letters of each case.
LETTERS, LETTER_BITS, LEAST_UPPER, LEAST_LOWER = re.compile(r"[A-Za-z]{20,}"), 3.4, 7, 5
#: Parts between dashes, underscores, slashes, plus and equals signs that end a span.
PART, PLAIN = re.compile(r"[^-_/+=]+|[-_/+=]+"), re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}")
#: Public strings: digests of the empty string, alphabets and counts.
PUBLIC = (
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words joined by dashes, underscores or slashes, a number here and there: names and paths.
NAMES = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/=+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[-_/=+]*")
#: Words of one case with short numbers between or after them, pronounceable: identifiers.
WORDS = re.compile(r"(?!.*[bcdfghjklmnpqrstvwxz]{5})[a-z]{4,}(?:[0-9]{1,4}[a-z]{4,})*[0-9]{0,4}"
                   r"|(?!.*[BCDFGHJKLMNPQRSTVWXZ]{5})[A-Z]{6,}(?:[0-9]{1,4}[A-Z]{6,})*[0-9]{0,4}")
#: n log2 n for the counts of a window.
_WEIGHT = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]

Span = tuple[int, int, str]


def public(candidate: str) -> bool:
    return (UUID.fullmatch(candidate) is not None or NAMES.fullmatch(candidate) is not None
            or WORDS.fullmatch(candidate) is not None or any(candidate.lower() == p or candidate in p for p in PUBLIC))


def random_parts(run: str, bits: float, kinds: tuple) -> Iterator[tuple[int, int]]:
    """Joined windows of a run that have the entropy and the kinds of characters."""
    counts: dict[str, int] = {}
    weight, mix = 0.0, [0] * len(kinds)
    start = end = -1
    most = WINDOW * (log2(WINDOW) - bits) + 1e-9
    for i, c in enumerate(run):
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            weight += _WEIGHT[n - 1] - _WEIGHT[n]
            for k, has in enumerate(kinds):
                mix[k] -= has(old)
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += _WEIGHT[n + 1] - _WEIGHT[n]
        for k, has in enumerate(kinds):
            mix[k] += has(c)
        if i >= WINDOW - 1 and weight <= most and all(mix):
            first = i - WINDOW + 1
            if first > end:
                if end >= 0:
                    yield start, end
                start = first
            end = i + 1
    if end >= 0:
        yield start, end


def drawn_out(run: str, start: int, end: int) -> tuple[int, int]:
    """The span with the parts of the run beside it, as far as they don't read as words or short numbers."""
    parts = [(m.start(), m.end()) for m in PART.finditer(run)]
    first = max(i for i, (a, _) in enumerate(parts) if a <= start)
    last = min(i for i, (_, b) in enumerate(parts) if b >= end)
    plain = lambda i: PLAIN.fullmatch(run, *parts[i]) is not None
    # a window may begin or end inside a word beside the key
    while first < last and (plain(first) or run[parts[first][0]] in "-_/+="):
        first += 1
    while last > first and (plain(last) or run[parts[last][0]] in "-_/+="):
        last -= 1
    while first > 0 and not plain(first - 1):
        first -= 1
    while last < len(parts) - 1 and not plain(last + 1):
        last += 1
    start, end = parts[first][0], parts[last][1]
    # separators at the edges belong to the text around
    return start + len(run[start:end]) - len(run[start:end].lstrip("-_/+")), end - len(run[start:end]) + len(run[start:end].rstrip("-_/+"))


def random_letters(run: str) -> bool:
    """Whether some window of a run of letters has the entropy, and letters of both cases more often than a name."""
    upper = [c.isupper() for c in run]
    inside = sum(upper[:WINDOW])
    for i in range(len(run) - WINDOW + 1):
        if i:
            inside += upper[i + WINDOW - 1] - upper[i - 1]
        if LEAST_UPPER <= inside <= WINDOW - LEAST_LOWER and any(True for _ in random_parts(run[i:i + WINDOW], LETTER_BITS, (str.isalpha,))):
            return True
    return False


def uncovered(span: tuple[int, int], base: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of a span outside the base spans, which are in order."""
    at, end = span
    for s, e, _ in base:
        if s >= end:
            break
        if s > at:
            yield at, s
        at = max(at, e)
    if at < end:
        yield at, end


def spans(text: str | None) -> list[Span]:
    """(start, end, kind) of all findings, by start, then kind."""
    if not text:
        return []
    found: list[Span] = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run of hex digits is matched whole, so asking for its length gives the same matches
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    base, more = sorted(found), set()
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        if public(candidate):
            continue
        for run in LETTERS.finditer(candidate):
            if not run[0].islower() and not run[0].isupper() and not public(run[0]) and random_letters(run[0]):
                more.add((m.start() + run.start(), m.start() + run.end()))
        if not any(map(str.isdigit, candidate)):
            continue
        for runs, bits, kinds in CLASSES:
            for run in runs.finditer(candidate):
                if not public(run[0]):
                    at = m.start() + run.start()
                    parts = [drawn_out(run[0], s, e) for s, e in random_parts(run[0], bits, kinds)]
                    more.update((at + s, at + e) for s, e in parts if not public(run[0][s:e]))
    joined: list[list[int]] = []
    for s, e in sorted(more):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e])
    free = [(s, e, "entropy") for span in joined for s, e in uncovered(span, base) if any(map(str.isalnum, text[s:e]))]
    return sorted(base + free, key=lambda x: (x[0], KINDS.index(x[2])))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, spans) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans(t)] for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], ["key", "spans"])

    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", _SPANS)])
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, kind).withColumnRenamed("key", key)


def redacted(text: str | None, instead: str) -> str | None:
    """The text with overlapping findings taken together and replaced."""
    parts, at, end = [], 0, 0
    for s, e, _ in spans(text):
        if s >= end:
            parts += [text[at:s], instead]
        end = at = max(end, e)
    return text if not parts else "".join(parts) + text[at:]


def redact(docs: DataFrame, instead: str = "[secret]") -> DataFrame:
    """The documents with their secrets replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, instead) for t in texts_of(batch, "text")]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(at).type):
                sizes = [n if n is None or t is None else len(t) for n, t in zip(batch.column(at).to_pylist(), texts, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Findings in every document, with a digest of those of the patterns."""
    ship(spark)
    found = scan(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.concat_ws(",", F.transform(base, one)), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform("spans", one)).alias("spans"), count("entropy"))
