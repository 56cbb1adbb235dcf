"""BPE with word ends as a streaming transducer with bounded lookahead, and its decoder.

Merging is deterministic, but a token is final only once enough of what follows is known. How much follows from the merge
list. Let two texts begin alike and differ later. Applying the merges by rank, the end of what both have in common moves
left only when the common symbol before it merges across it in one of them, which costs that symbol; the next merge that
does so has a higher rank, and its right part begins with the symbol lost before. So the loss is bounded by the longest
chain of merges with rising ranks in which each right part begins with the left part of one before; ``lookahead`` finds
its length from the merge list by dynamic programming. A token that ends so many bytes before the end of the input can't
change any more, is emitted, and what precedes it is forgotten: memory is constant, however long a word is.

Texts are read in blocks, normalised and cut to words as the vocabulary file says (canonical composition, lower case by
character, words of letters, single digits, runs of other signs; white space dropped). Blocks begin at characters that
compose with nothing before them. What has no white space yet is held back; a word that outgrows ``LONG`` flows into the
transducer while it is read. All words go through the transducer; a table of bounded size remembers what it gave for
short ones. The decoder takes ids one block at a time, cuts their bytes to pieces of fixed size wherever they fall, and
turns them into text by a state machine that keeps an unfinished character.

Bounds: a text itself is one value of its row; beside it a few blocks are held. A run of combining marks stays in one block.

Defined results: a null or empty text has no ids and decodes to an empty text. Special tokens in a text are taken as such.
Repeated rows are encoded each. Other columns are ignored. Truncation and padding are not used.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from corpusloom.llm.common import byte_symbols, loaded, packed, table, texts_of, vocabulary
from corpusloom.session import ship

#: Fixed value: the words of a normalised text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Symbols taken in between two looks for stable tokens; words in the table, and their longest.
STEP, WORDS_KEPT, SHORT = 256, 400_000, 40
_NONE = (1 << 60, 0)
#: Characters read at once; the longest run without white space that is held back; ids and bytes given on at once.
BLOCK, LONG, GIVEN = 1 << 16, 1 << 12, 1 << 14
_LAST_BLANK = regex.compile(r"(?r)\s")


def lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a token's end that settle it; merges are (left, right, made) by rank."""
    rank_of = {made: rank for rank, (_, _, made) in enumerate(merges)}
    first = {made: left for left, _, made in merges}
    # per symbol that is some merge's left part: the ranks of those merges, and the largest loss up to each
    ranks: dict[int, list[int]] = {}
    losses: dict[int, list[int]] = {}

    def worst(symbol: int, below: int) -> int:
        at = bisect_left(ranks.get(symbol, ()), below)
        return losses[symbol][at - 1] if at else 0

    most = 0
    for rank, (left, right, _) in enumerate(merges):
        before, symbol = worst(right, rank), right
        while symbol in first:
            before = max(before, worst(first[symbol], rank_of[symbol] + 1))
            symbol = first[symbol]
        loss = length[left] + before
        most = max(most, loss)
        ranks.setdefault(left, []).append(rank)
        known = losses.setdefault(left, [])
        known.append(max(loss, known[-1] if known else 0))
    return most


class Merges:
    """A merge list: merges whole symbol sequences, and streams of symbols with bounded lookahead."""

    def __init__(self, merges: list[tuple[int, int, int]], length: dict[int, int]):
        self.rank = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(merges)}
        self.length, self.ahead = length, lookahead(merges, length)

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of a complete sequence: the leftmost pair of the lowest rank is merged, again and again."""
        symbols = list(symbols)
        if len(symbols) > 64:
            return self._merged_long(symbols)
        get = self.rank.get
        ranks = [get(p, _NONE) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is _NONE:
                break
            i = ranks.index(best)
            symbols[i] = best[1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], best[1]), _NONE)
            if i < len(ranks):
                ranks[i] = get((best[1], symbols[i + 1]), _NONE)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs and a list of neighbours."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if i < n else n
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = self.rank[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (symbols[a], symbols[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[symbols[a], symbols[b]][0], a, (symbols[a], symbols[b])))
        return [s for s in symbols if s >= 0]

    def stream(self, symbols: Iterable[int], last) -> Iterator[int]:
        """The tokens of a sequence that arrives symbol by symbol; ``last`` turns its final symbol into the one at an end."""
        held: list[int] = []
        for symbol in symbols:
            held.append(symbol)
            # the newest symbol may yet be the last, so it is left out
            if len(held) > self.ahead + STEP:
                done, kept = 0, len(held) - 1 - self.ahead
                for token in self.merged(held[:-1]):
                    if done + self.length[token] > kept:
                        break
                    done += self.length[token]
                    yield token
                held = held[done:]
        if held:
            held[-1] = last(held[-1])
            yield from self.merged(held)


class WordBpe:
    """A vocabulary file with word ends, and lower-case text without white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, symbols = content["model"], byte_symbols()
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbol = [0] * 256
        for c, b in symbols.items():
            self.symbol[b] = self.vocab[c]
        self.at_end = {self.vocab[c]: self.vocab[c + self.suffix] for c in symbols}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        length = {i: len(t.removesuffix(self.suffix)) or len(t) for t, i in self.vocab.items()}
        self.merges = Merges([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], length)
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.token_bytes = {i: t.encode("utf-8") for i, t in self.tokens.items()}
        self._learn_characters(Tokenizer.from_file(path))
        self.table = _Table(self)

    def _learn_characters(self, library: Tokenizer) -> None:
        """Where character tables of different age disagree, the library's count: letters and digits that are other signs
        to it, and those whose lower case is another there."""
        known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(0x110000))))
        pieces = library.pre_tokenizer.pre_tokenize_str(" ".join("!" + c for c in known))
        signs = {known[start // 3] for _, (start, end) in pieces if end - start == 2}
        alone = "!".join(known)
        theirs, ours = library.normalizer.normalize_str(alone).split("!"), normalised(alone).split("!")
        self.lower = {c: a for c, a, b in zip(known, theirs, ours, strict=True) if a != b}
        late = "".join(map(regex.escape, sorted(signs)))
        self.late = frozenset(signs | {*self.lower})
        none = f"(?![{late}])" if signs else ""
        sign = rf"(?:[^\s\p{{L}}\p{{N}}]|[{late}])" if signs else r"[^\s\p{L}\p{N}]"
        letter = rf"(?:{none}\p{{L}})"
        self.exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{none}\p{{N}}|{sign}+")
        self.runs = {True: (regex.compile(r"\p{L}*+"), regex.compile(f"{letter}*+")),
                     False: (regex.compile(r"[^\s\p{L}\p{N}]*+"), regex.compile(f"{sign}*+"))}

    def word_ids(self, word: str) -> Iterator[int]:
        symbol = self.symbol
        return self.merges.stream((symbol[b] for b in word.encode("utf-8")), self.at_end.__getitem__)

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self.id_blocks(text))

    def id_blocks(self, text: str | None) -> Iterator[bytes]:
        """The same, block by block."""
        at = 0
        for special in self.cut.finditer(text or "") if self.cut else ():
            yield from self._part(text, at, special.start())
            yield packed([self.special[special.group()]])
            at = special.end()
        yield from self._part(text or "", at, len(text or ""))

    def _blocks(self, text: str, at: int, end: int) -> Iterator[str]:
        """Normalised blocks of a part of a text."""
        while at < end:
            cut = min(at + BLOCK, end)
            while cut < end and text[cut] >= "\u0300" and text[cut] in _composing():
                cut += 1
            block = text[at:cut]
            if not self.late.isdisjoint(block):
                block = "".join(self.lower.get(c) or normalised(c) for c in unicodedata.normalize("NFC", block))
            else:
                block = normalised(block)
            yield block
            at = cut

    def _part(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of a part of a text without special tokens."""
        blocks, held, of = self._blocks(text, at, end), "", self.table.__getitem__
        for block in blocks:
            block = held + block
            blank = _LAST_BLANK.search(block)
            known, held = (block[:blank.start()], block[blank.end():]) if blank else ("", block)
            if known:
                yield b"".join(map(of, self._cut(known).findall(known)))
            if len(held) > LONG:
                found = list(self._cut(held).finditer(held))
                last = found[-1]
                if len(last[0]) > LONG:
                    yield b"".join(of(m[0]) for m in found[:-1])
                    rest: list[str] = []
                    ids = self.merges.stream(self._run(last[0], blocks, rest), self.at_end.__getitem__)
                    while some := packed(list(islice(ids, GIVEN))):
                        yield some
                    held = rest[0] if rest else ""
                else:
                    # what comes next can change only words that end in the last two characters
                    done = [m for m in found if m.end() < len(held) - 2]
                    yield b"".join(of(m[0]) for m in done)
                    held = held[done[-1].end():] if done else held
        yield b"".join(map(of, self._cut(held).findall(held)))

    def _run(self, head: str, blocks: Iterator[str], rest: list[str]) -> Iterator[int]:
        """Symbols of a long word that begins with ``head``, read from the blocks to come; what follows it goes to ``rest``."""
        plain, exact = self.runs[bool(self.runs[True][1].match(head[0])[0])]
        yield from map(self.symbol.__getitem__, head.encode("utf-8"))
        for block in blocks:
            end = (plain if self.late.isdisjoint(block) else exact).match(block).end()
            yield from map(self.symbol.__getitem__, block[:end].encode("utf-8"))
            if end < len(block):
                rest.append(block[end:])
                return

    def _cut(self, block: str) -> regex.Pattern:
        return WORDS if block.isascii() or self.late.isdisjoint(block) else self.exact

    def decoded(self, ids: bytes | Iterable[bytes]) -> Iterator[str]:
        """The text of ids, block by block, as the tokenizers library writes it where a file names no decoder."""
        machine, lead, of = codecs.getincrementaldecoder("utf-8")("replace"), b"", self.token_bytes
        for block in [ids] if isinstance(ids, bytes) else ids:
            numbers = np.frombuffer(block, "<u4")
            for at in range(0, len(numbers), GIVEN):
                read = lead + b" ".join(map(of.__getitem__, numbers[at:at + GIVEN].tolist()))
                lead = b" "
                for i in range(0, len(read), GIVEN):
                    yield machine.decode(read[i:i + GIVEN])
        yield machine.decode(b"", True)

    def plain(self, ids: bytes) -> Iterator[str]:
        """The words of ids as plain text: bytes put together, a blank for each word end."""
        machine, symbols = codecs.getincrementaldecoder("utf-8")("replace"), byte_symbols()
        for token in np.frombuffer(ids, "<u4").tolist():
            if self.tokens[token] in self.special:
                yield machine.decode(b"", True) + self.tokens[token]
                machine.reset()
                continue
            word = self.tokens[token]
            ended = word.endswith(self.suffix)
            yield machine.decode(bytes(symbols[c] for c in word.removesuffix(self.suffix)) + b" " * ended)
        yield machine.decode(b"", True)


class _Table(dict):
    """What the transducer gave for short words, packed; emptied when full."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        out = packed(list(self.bpe.word_ids(word)))
        if len(word) <= SHORT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = out
        return out


@cache
def _composing() -> frozenset[str]:
    """Characters that can change together with what stands before them when a text is composed."""
    marks, second = set(), {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x300, 0x110000)):
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            marks.add(c)
        if parts and parts[0] != "<" and " " in parts:
            second.add(chr(int(parts.split()[1], 16)))
    joins = marks | second
    begins = {c for c in map(chr, range(0x300, 0x110000)) if unicodedata.decomposition(c) and unicodedata.normalize("NFD", c)[0] in joins}
    return frozenset(joins | begins)


def normalised(text: str) -> str:
    """Composed and in lower case, each character by itself."""
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def encode(docs: DataFrame, vocab: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row."""
    return _over(docs, key, [("ids", T.BinaryType(), pa.binary())], lambda bpe, text: (bpe.ids(text),), vocab)


def _over(docs: DataFrame, key: str, columns: list[tuple], of, vocab: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(WordBpe, vocab)
        for batch in batches:
            rows = [of(bpe, t) for t in texts_of(batch, "text")]
            arrays = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *(c[0] for c in columns)])

    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(n, t) for n, t, _ in columns)])
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, kind).withColumnRenamed("key", key)


def _digests(bpe: WordBpe, text: str | None) -> tuple[int, str, str]:
    """Number and digest of the ids of a text and digest of what they decode to, all fed block by block."""
    seen, read, n = sha256(), sha256(), 0

    def ids() -> Iterator[bytes]:
        nonlocal n
        for block in bpe.id_blocks(text):
            seen.update(block)
            n += len(block) // 4
            yield block

    for part in bpe.decoded(ids()):
        read.update(part.encode("utf-8"))
    return n, seen.hexdigest(), read.hexdigest()


def op9_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    ship(spark)
    columns = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _over(table(spark, sf_dir, "documents"), "doc_id", columns, _digests, vocabulary("word_bpe_49k.json"))
