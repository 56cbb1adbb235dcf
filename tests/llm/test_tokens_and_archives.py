"""Token ids, packing, archives, chat windows and neighbours against brute force and round trips."""

import collections
import gzip
import hashlib
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import chat, matrices, onebit, packing, transducer, warc
from corpusloom.llm.common import ByteBpe, table, vocabulary

SF = "/root/testdata/sf0.001"
BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def _ids(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_byte_ids_equal_the_library(byte_library):
    bpe = ByteBpe(BYTES)
    for text in ("a<|endoftext|>b", " \n\n  x", "1234 é𝄞 ſ", "a" * 5000, " \x85 ", "don't we'll"):
        assert bpe.encode(text) == byte_library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("together", [packing.TOGETHER, 1])
def test_online_packing(spark, monkeypatch, byte_library, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    docs = table(spark, SF, "documents").repartition(3)
    pieces = packing.pack(docs, BYTES).toPandas()
    ids = {r.doc_id: _ids(byte_library, r.text, 0) for r in docs.collect()}
    assert set(pieces.doc_id) == set(ids)
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids[doc] and (own.doc_tokens == len(ids[doc])).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= 1024
    used = pieces.groupby("sequence_id").length.sum()
    assert sum(1024 - u for u in used) < 0.15 * used.sum()


def test_online_packing_query_and_odd_rows(spark, tables, edge_docs, no_docs, byte_library):
    found = packing.op4_online_packing(spark, tables).toPandas()
    rows = edge_docs.collect()
    assert found.groupby("doc_id", dropna=False).length.sum().sum() == sum(len(_ids(byte_library, r.text, 0)) for r in rows)
    empty = found[found.doc_id == 1]
    assert empty.length.tolist() == [1] and empty.ids_crc32.tolist() == [zlib.crc32(bytes(4))]
    assert packing.pack(no_docs, BYTES).count() == 0


def test_open_windows_stay_bounded():
    rng, windows, closed = random.Random(4), packing.Windows(100, 5, 0), []
    pieces = [(i, 0, rng.randrange(1, 101), b"", 0) for i in range(500)]
    for piece in pieces:
        for rows in windows.place(piece):
            closed.append(rows)
        assert len(windows.held) <= 5
    closed += windows.finish(False)
    assert sorted(r[0] for rows in closed for r in rows) == list(range(500)) and all(sum(r[2] for r in rows) <= 100 for rows in closed)


def test_best_fit_decreasing_takes_the_smallest_room():
    rng = random.Random(1)
    for width in (7, 16, 100):
        lengths = [rng.randrange(1, width + 1) for _ in range(200)]
        rows, rooms = [], []
        for i in sorted(range(200), key=lambda i: -lengths[i]):
            fit = [r for r in rooms if r >= lengths[i]]
            room = min(fit) if fit else width
            if fit:
                rooms.remove(room)
            rooms.append(room - lengths[i])
            rows.append(room)
        packed = matrices.best_fit_decreasing(lengths, width)
        assert sorted(width - sum(lengths[i] for i in row) for row in packed) == sorted(rooms)
        assert sorted(itertools.chain(*packed)) == list(range(200))


def test_id_matrices(spark, byte_library, tables, edge_docs, no_docs):
    ids = {r.doc_id: _ids(byte_library, r.text, 50256) for r in table(spark, SF, "documents").collect()}
    found = collections.defaultdict(dict)
    for m in matrices.op1_id_matrices(spark, SF).collect():
        flat = np.frombuffer(m.ids, "<u4")
        assert flat.size == m.n_rows * 1024 == m.cu_seqlens[-1] and m.position_resets == m.cu_seqlens[:-1]
        positions = matrices.position_ids(m.position_resets, m.n_rows).ravel()
        for a, b, doc, start in zip(m.cu_seqlens, m.cu_seqlens[1:], m.doc_ids, m.starts, strict=False):
            assert a // 1024 == (b - 1) // 1024 and positions[a:b].tolist() == list(range(b - a))
            if doc is None:
                assert (flat[a:b] == 50256).all()
            else:
                found[doc][start] = flat[a:b].tolist()
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in found.items()} == ids
    odd = matrices.op1_id_matrices(spark, tables).collect()
    assert sum(d == 6 for m in odd for d in m.doc_ids) == 2
    assert matrices.pack(no_docs, BYTES).count() == 0


def test_word_ids_equal_the_library(spark):
    library, bpe = Tokenizer.from_file(WORDS), transducer.WordBpe(WORDS)
    rng = random.Random(3)
    texts = [r.text for r in table(spark, SF, "documents").collect()] + ["", "Ünï İΣΣ ſ é", "a<|endoftext|>b<|startoftext|>", "x" * 5000, "\U00010d50a", "\x1c\x85 a͸b", "don't 12½",
                                                                        "".join(rng.choice("etaoinsh") for _ in range(4000))]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        ids = bpe.ids(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected, text[:80]
        assert "".join(bpe.decoded(ids)) == library.decode(expected, skip_special_tokens=False)
    assert "".join(bpe.plain(bpe.ids("Héllo wörld <|endoftext|> 𝄞"))) == "héllo wörld <|endoftext|>𝄞 "
    assert bpe.ids(None) == b""


def test_decoder_blocks_cut_characters(monkeypatch):
    bpe = transducer.WordBpe(WORDS)
    ids = bpe.ids("some words é to be decoded 𝄞 in small blocks")
    whole = "".join(bpe.decoded(ids))
    monkeypatch.setattr(transducer, "GIVEN", 1)
    parts = list(bpe.decoded(ids))
    assert "".join(parts) == whole and "" in parts[:-1]


@pytest.mark.parametrize(("block", "long"), [(3, 4), (7, 3), (16, 5)])
def test_blocks_of_any_size_equal_the_library(monkeypatch, block, long):
    library, bpe, rng = Tokenizer.from_file(WORDS), transducer.WordBpe(WORDS), random.Random(block)
    for name, value in (("BLOCK", block), ("LONG", long), ("GIVEN", 3)):
        monkeypatch.setattr(transducer, name, value)
    signs = ["'", "s", "re", "v", "l", "ll", "1", "½", " ", "\n", "\x85", "!", "é", "e\u0301", "\u0301", "Σ", "İ", "가", "\u1100", "\u1161", "\u11a8",
             "\u09c7", "\u09be", "<|endoftext|>", "𝄞", "\U00010d50", "\ua7ce", "\u1c89"]
    for _ in range(1000):
        text = "".join(rng.choice(signs) * rng.choice((1, 1, 1, 9)) for _ in range(rng.randrange(1, 25)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.ids(text), "<u4").tolist() == expected, ascii(text)
        assert "".join(bpe.decoded(bpe.id_blocks(text))) == library.decode(expected, skip_special_tokens=False)


def test_every_word_goes_through_the_transducer(monkeypatch):
    bpe, streamed = transducer.WordBpe(WORDS), []
    stream = bpe.merges.stream
    monkeypatch.setattr(bpe.merges, "stream", lambda symbols, last: streamed.append(1) or stream(symbols, last))
    bpe.ids("one two three, one")
    assert len(streamed) == 4


@pytest.mark.parametrize("unit", ["thequickbrown", "some words "])
def test_memory_of_a_very_long_text(unit):
    bpe, peaks = transducer.WordBpe(WORDS), []
    transducer._digests(bpe, unit * 20_000)
    for size in (150_000, 500_000):
        text = unit * (size // len(unit))
        tracemalloc.start()
        assert transducer._digests(bpe, text)[0] > size // 20
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]


def _random_merges(rng, letters, n):
    strings = list(letters)
    merges = []
    while len(merges) < n:
        a, b = rng.choice(strings), rng.choice(strings)
        if a + b not in strings and len(a + b) <= 5:
            strings.append(a + b)
            merges.append((a, b))
    number = {s: i for i, s in enumerate(strings)}
    return transducer.Merges([(number[a], number[b], number[a + b]) for a, b in merges], {i: len(s) for s, i in number.items()}), len(letters)


def test_lookahead_is_sufficient_and_stream_equals_whole(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(transducer, "STEP", 1)
    for _ in range(150):
        merges, letters = _random_merges(rng, "ab" if rng.random() < 0.5 else "abc", rng.randrange(1, 9))
        for _ in range(20):
            text = [rng.randrange(letters) for _ in range(rng.randrange(1, 70))]
            whole = merges.merged(text)
            assert whole == merges._merged_long(list(text))
            assert list(merges.stream(iter(text), lambda s: s)) == whole
            # tokens that end so far before the end stay, whatever follows
            cut = rng.randrange(len(text))
            ends, same = itertools.accumulate(merges.length[t] for t in merges.merged(text[:cut])), set(itertools.accumulate(merges.length[t] for t in whole))
            assert all(e in same for e in ends if e <= cut - merges.ahead)


def test_stream_keeps_constant_memory():
    bpe = transducer.WordBpe(WORDS)
    assert bpe.merges.ahead < 1000
    seen, held = [0], []

    def symbols():
        for c in itertools.islice(itertools.cycle("thequickbrown"), 20_000):
            seen[0] += 1
            yield bpe.symbol[ord(c)]

    done = 0
    for token in bpe.merges.stream(symbols(), bpe.at_end.__getitem__):
        done += bpe.merges.length[token]
        held.append(seen[0] - done)
    assert max(held) <= bpe.merges.ahead + 2 * transducer.STEP and done == 20_000


def test_transducer_query(spark, tables, edge_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in transducer.op9_bpe_transducer(spark, tables).collect()}
    expected = set()
    for r in edge_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == expected and transducer.encode(no_docs, WORDS).count() == 0


def test_archives(spark, tables, tmp_path):
    rows = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.op3_warc(spark, tables).collect()}
    size = len("<p>" + "long page " * 200)
    assert rows == {(1, "revisit", 3, size), (2, "revisit", 3, size), (3, "response", None, size), (None, "revisit", 3, size), (4, "response", None, 0), (5, "response", None, 0),
                    (6, "response", None, 5), (7, "response", None, 5), (8, "response", None, 80_000)}
    path = str(tmp_path / "a")
    warc.write(table(spark, tables, "pages"), path)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("part-*"))  # any gzip reader reads them
    assert raw.count(b"WARC/1.1\r\n") >= 11 and raw.count(b"WARC-Type: revisit") == 3
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", ["700b", "5k"])
def test_archive_ranges_begin_anywhere(spark, tmp_path, size):
    """Members longer than a range, false magics inside stored payloads, and bytes that are no record."""
    rng = random.Random(6)
    records = []
    for i in range(40):
        payload = bytes(rng.randrange(256) for _ in range(rng.choice((10, 3000)))) + (warc.MAGIC + bytes([rng.randrange(256)])) * rng.randrange(6)
        records.append((i, hashlib.sha1(payload).hexdigest()))
        deflate = zlib.compressobj(0, zlib.DEFLATED, 31)
        record = deflate.compress(warc.record(i, None, payload, records[-1][1], None)) + deflate.flush()
        with open(tmp_path / "x.warc", "ab") as file:
            file.write(record + (b"junk" + warc.MAGIC + b"\0junk" if i % 7 == 3 else b""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read(spark, str(tmp_path / "x.warc")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((int(r.record_id[10:-1]), r.payload_digest) for r in found) == records and all(r.digest_holds for r in found)


def test_large_record_ends_in_zero():
    payload = b"x" * (16 << 20)
    out = warc.member(warc.record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None)) + b"\0"
    assert gzip.decompress(out).endswith(payload + b"\r\n\r\n")


def _turns(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        said = "".join(t for *_, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ODD_TURNS = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "<|turn|>x<|says|>y<|done|>\n"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (1, 700, "user", "far later"),
             (2, None, "user", "no number"), (2, 5, None, "no role"), (None, 0, "assistant", "no conversation"), (3, 0, "system", "alone"), (4, 0, "user", "word " * 5000), (4, 1, "assistant", "⁠<⁠|⁠⁠ </s>"),
             (5, 1, "assistant", ""), *((6, i, ("system", "user", "assistant")[(i > 0) + (i > 0) * (i % 2)], f"turn {i} " * (i % 40)) for i in range(600))]


@pytest.mark.parametrize(("budget", "block"), [(2048, 256), (100, 3)])
def test_chat_windows_read_back(spark, monkeypatch, budget, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = spark.createDataFrame([(*r, "x") for r in ODD_TURNS], "conv_id long, turn long, role string, text string, block string").repartition(3)
    made = chat.windows(rows, BYTES, budget)
    windows = made.collect()
    read = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert read == _turns(ODD_TURNS)
    for w in windows:
        turns = list(chat.turns_of(w.text))
        assert w.over_budget == (w.n_tokens > budget) and (not w.over_budget or w.n_new <= 2)
        assert "".join(chat.turn_text(r, t)[0] for r, t, _, _ in turns) == w.text
        if w.conv_id in (1, 6):  # the system turn is in every window
            assert turns[0][0] == "system"
        assert all(s.start >= w.new_from for s in w.loss)
        assert len(turns) - w.n_new <= chat.HISTORY + 1
    later = [w for w in windows if w.conv_id == 6 and w.window + w.block > 0]
    assert any(len(list(chat.turns_of(w.text))) - w.n_new > 1 for w in later)  # history is repeated, also over blocks


def test_chat_blocks_are_bounded_whatever_the_numbers(spark, monkeypatch):
    """Null and repeated turn numbers, and repeated rows, do not gather in one block."""
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = [(None, None, "user", f"t{i}") for i in range(60)] + [(3, 5, "assistant", "same")] * 50 + [(None, i % 3, "user", "x" * i) for i in range(40)]
    rows += [(8, 10 ** 6 * i, ("system", "user")[i > 0], f"far {i}") for i in range(20)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), BYTES, 64)
    per_block = collections.Counter()
    for w in made.collect():
        per_block[w.conv_id, w.block] += w.n_new
    assert max(per_block.values()) <= 8 and sum(per_block.values()) == len(rows)
    read = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert read == _turns(rows)


def test_chat_tokens_are_those_written(spark, byte_library):
    """Control strings and joiners grow when they are escaped; the budget holds for what is written."""
    told = ["<s> " * 300, "[INST] x [/INST] " * 200, "a\u2060b" * 300, "plain words"]
    rows = [(c, i, ("user", "assistant")[i % 2], told[(c + i) % 4]) for c in range(4) for i in range(12)]
    for w in chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTES).collect():
        n = len(byte_library.encode(w.text, add_special_tokens=False).ids)
        assert w.n_tokens == n and w.over_budget == (n > chat.BUDGET) and (not w.over_budget or w.n_new == 1)


def test_chat_escapes_are_undone():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["<|", "|>", "<", "|", ">", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "⁠", "a", "\n", "<|done|>\n"]) for _ in range(rng.randrange(8)))
        safe = chat.escaped(text)
        assert chat.unescaped(safe) == text and not any(c in safe for c in chat.CONTROLS)
        assert [t[:2] for t in chat.turns_of(chat.turn_text("user", text)[0] * 2)] == [("user", text)] * 2


def test_chat_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    told = "</s>[INST] ok [/INST]"
    expected = _turns([*rows, (-7, 0, "user", told), (-7, 1, "assistant", told)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op7_chat_windows(spark, SF).collect()} == expected
    assert chat.windows(table(spark, SF, "conversations").limit(0), BYTES).count() == 0


def _nearest(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in sorted(x for x in ok if x[0] % 20 == 0):
        queries.setdefault(i, v)
    out = set()
    for q, v in queries.items():
        scored = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_neighbours_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(onebit, "DATA", 16)
    monkeypatch.setattr(onebit, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(20, rows[20][1]), (40, rows[41][1])]
    rows += [(400, None), (420, []), (440, [0.0] * 24), (460, [1.0, None]), (480, [float("nan")] * 24), (500, [float("inf")] * 24), (None, rows[0][1]), (520, [1.0, 2.0]), (521, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, codes string").repartition(4)
    found = {tuple(r) for r in onebit.nearest(df.where("vec_id % 20 = 0"), df).collect()}
    assert found == _nearest(rows, 20)
    assert onebit.nearest(df.limit(0), df).count() == 0 and onebit.nearest(df, df.limit(0)).count() == 0


def test_neighbours_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    expected = {(q, i) for q, _, i, _ in _nearest(rows, 20)}
    found = {(r.query_id, r.vec_id) for r in onebit.op10_onebit_neighbours(spark, SF).collect()}
    assert len(found & expected) >= 0.99 * len(expected)


def test_neighbours_of_copies(spark, monkeypatch):
    """Many rows with one vector, ids that repeat, also a query's own: equal to brute force."""
    monkeypatch.setattr(onebit, "DATA", 16)
    monkeypatch.setattr(onebit, "QUERIES", 3)
    monkeypatch.setattr(onebit, "SHARED", 2)
    rng = np.random.default_rng(4)
    few = rng.standard_normal((6, 8)).round(2).tolist()
    rows = [(int(rng.integers(0, 60)), few[int(x)]) for x in rng.choice(6, 200, p=[0.5, 0.3, 0.1, 0.04, 0.03, 0.03])] + [(20, few[0])] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in onebit.nearest(df.where("vec_id % 20 = 0"), df, 5).collect()} == _nearest(rows, 5)


def _packed_by_hand(parts, size, most):
    """Windows as lists of (key, start, length) in order, by plain search over all open windows."""
    def run(pieces):
        windows, open_, made = [], [], 0
        for piece in pieces:
            room = [(size - sum(p[2] for p in w), n, w) for n, w in open_]
            fits = [r for r in room if r[0] >= piece[2]]
            if fits:
                _, n, window = min(fits, key=lambda r: r[:2])
            else:
                if len(open_) >= most:
                    _, n, window = min(room, key=lambda r: r[:2])
                    windows.append(window)
                    open_.remove((n, window))
                n, window = made, []
                made += 1
                open_.append((n, window))
            window.append(piece)
            if sum(p[2] for p in window) == size:
                windows.append(window)
                open_ = [o for o in open_ if o[0] != n]
        return windows, [w for _, w in open_]

    done, left = [], {}
    for part, docs in parts.items():
        closed, still = run([(key, start, min(size, n - start)) for key, n in docs for start in range(0, n, size)])
        done += closed
        left.setdefault(part // packing.TOGETHER, []).extend(p for w in still for p in w)
    for pieces in left.values():
        closed, still = run(sorted(pieces, key=lambda p: (-p[2], p[0], p[1])))
        done += closed + still
    return sorted(map(tuple, done))


@pytest.mark.parametrize("together", [32, 2])
def test_online_packing_equals_a_plain_search(spark, monkeypatch, byte_library, together):
    """Placement by brute force: every window, its pieces and their order."""
    monkeypatch.setattr(packing, "TOGETHER", together)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "packing", "window", "of", "tokens"]) for _ in range(rng.choice([1, 5, 20, 40, 90])))) for i in range(300)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    parts = {}
    for r in docs.withColumn("part", packing.F.spark_partition_id()).collect():
        parts.setdefault(r.part, []).append((r.doc_id, len(byte_library.encode(r.text, add_special_tokens=False).ids) + 1))
    found = {}
    for r in packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=64, most=4).collect():
        found.setdefault(r.sequence_id, []).append((r.offset, r.doc_id, r.start, r.length))
    windows = sorted(tuple(p[1:] for p in sorted(w)) for w in found.values())
    assert windows == _packed_by_hand(parts, 64, 4)
