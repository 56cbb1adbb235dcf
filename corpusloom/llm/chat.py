"""Chat transcripts as training windows under a token budget.

A window is a span of whole turns. Per block of a conversation, prefix sums of the turns' tokens tell how far a window may
go, counted on the turns as they are written: from its first new turn as many as fit the budget beside the system turn and a limited history, one at least. A
conversation's system turn (its first turn, if its role is ``system``) stands in every window; the last turns before the
span are repeated as history, as many as fit a quarter of the budget. What is repeated is masked: each assistant text is a
target in the one window where it is new.

A conversation of any length is worked on in blocks of ``BLOCK`` turns by their place in the order of turn number, role and
text, whatever the numbers are; each gets the system turn and the turns before it that may be history, so no task holds a
whole conversation. Places are counted in sorted pieces of all turns; what a piece's first conversation had before is added.

The template marks turns; control strings inside texts are escaped by a word joiner after their first character, and word
joiners of the text are doubled, which can be undone exactly. Offsets are code points.

Defined results: a null text is empty, a null role is written as an empty one. A null conversation id is a conversation,
null turn numbers come first in it. Turns with equal numbers are kept, ordered by role and text. A turn larger than the
budget has a window of its own, marked ``over_budget``. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ByteBpe, loaded, table, texts_of, vocabulary
from corpusloom.session import ship
from corpusloom.storage import stage

#: Tokens of a window, turns of history, turns of a block.
BUDGET, HISTORY, BLOCK = 2048, 2, 256
#: Characters of a text by which turns of equal number and role are spread over pieces.
HEAD = 256
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|turn|>", "<|says|>", "<|done|>\n"
#: Strings that may not stand unescaped in a text: this template's and those of others in use.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
JOINER = "\u2060"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_MARKED = re.compile(re.escape(ROLE_OPEN) + "(.*?)" + re.escape(ROLE_CLOSE) + "(.*?)" + re.escape(TURN_CLOSE), re.S)


def escaped(text: str) -> str:
    """The text without control strings."""
    text = text.replace(JOINER, JOINER * 2)
    # a control string may begin inside another, so each pass leaves fewer
    while _CONTROL.search(text):
        text = _CONTROL.sub(lambda m: m[0][0] + JOINER + m[0][1:], text)
    return text


def unescaped(text: str) -> str:
    """What ``escaped`` was given: a lone joiner was put in, a pair stands for one."""
    return re.sub(JOINER + "+", lambda m: JOINER * (len(m[0]) // 2), text)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """A turn in the template and where its text begins there."""
    lead = ROLE_OPEN + escaped(role) + ROLE_CLOSE
    return lead + escaped(text) + TURN_CLOSE, len(lead)


def turns_of(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted text; the span is that of the escaped text."""
    for m in _MARKED.finditer(formatted):
        yield unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)


_WINDOW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("new_from", pa.int64()), ("n_new", pa.int64()),
                     ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_WINDOW_SQL = ("conv_id long, block long, window long, text string, new_from long, n_new long, n_tokens long, over_budget boolean, "
               "loss array<struct<start: long, end: long>>")


def block_windows(system: tuple | None, history: list[tuple], turns: list[tuple], budget: int, most: int) -> Iterator[dict]:
    """Windows of a block's turns; a turn is (role, text, tokens). ``history`` is what came before the block."""
    ahead = len(history)
    line = history + turns
    sums = np.concatenate([[0], np.cumsum([t[2] for t in line])])
    kept = system[2] if system else 0
    at, number = ahead, 0
    while at < len(line):
        back = at
        while back and at - back < most and sums[at] - sums[back - 1] <= budget // 4:
            back -= 1
        room = budget - kept - (sums[at] - sums[back])
        if line[at][2] > room:  # the new turn comes first
            back, room = at, budget - kept
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + room, "right")) - 1)
        parts, loss, size = [], [], 0
        repeated = ([system] if system and not (system[3] and at == ahead) else []) + line[back:at]
        fresh = ([system] if system and system[3] and at == ahead else []) + line[at:end]
        for turn in repeated:
            parts.append(turn_text(turn[0], turn[1])[0])
        new_from = size = sum(map(len, parts))
        for turn in fresh:
            text, lead = turn_text(turn[0], turn[1])
            if turn[0] == "assistant":
                loss.append({"start": size + lead, "end": size + len(text) - len(TURN_CLOSE)})
            parts.append(text)
            size += len(text)
        tokens = int(kept + sums[end] - sums[back])
        yield {"window": number, "text": "".join(parts), "new_from": new_from, "n_new": len(fresh), "n_tokens": tokens, "over_budget": tokens > budget, "loss": loss}
        at, number = end, number + 1
    if system and system[3] and not turns:
        text, _ = turn_text(system[0], system[1])
        yield {"window": number, "text": text, "new_from": 0, "n_new": 1, "n_tokens": system[2], "over_budget": system[2] > budget, "loss": []}


def _counted(vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBpe, vocab)
        conv, number = None, 0
        for batch in batches:
            numbers = []
            for c in batch.column(0).to_pylist():
                conv, number = (c,), number + 1 if conv == (c,) else 0
                numbers.append(number)
            sizes = [len(bpe.encode(turn_text(r, t)[0])) for r, t in zip(texts_of(batch, "role"), texts_of(batch, "text"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())], [*batch.schema.names, "number", "tokens"])

    return run


def windows(conversations: DataFrame, vocab: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, block, window, text, new_from, n_new, n_tokens, over_budget, loss) of every window, in this order."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # pieces are cut by the heads of long texts, so that few bytes are sampled; equal short turns may part anywhere
    head = F.substring("text", 1, HEAD)
    any_ = F.when(F.length("text") <= HEAD, -1 - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 62))).otherwise(0)  # a short text comes before longer ones with its head
    line = ["conv_id", "turn", "role", "text"]
    spread = rows.withColumn("head", head).withColumn("any", any_).repartitionByRange("conv_id", "turn", "role", "head", "any")
    rows = stage(spread.select(*line).sortWithinPartitions(*line).withColumn("piece", F.spark_partition_id().cast("long")).mapInArrow(
        _counted(vocab), "conv_id long, turn long, role string, text string, piece long, number long, tokens long"), "turns")
    sizes = rows.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    # a piece begins inside one conversation at most: these are no more rows than pieces
    later = sizes.withColumn("before", before).where("before > 0").select(F.col("conv_id").alias("c_"), F.col("piece").alias("p_"), "before")
    here = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("piece") == F.col("p_"))
    placed = rows.join(F.broadcast(later), here, "left").withColumn("place", F.col("number") + F.coalesce("before", F.lit(0)))
    said = placed.withColumn("block", F.floor(F.col("place") / BLOCK)).select("conv_id", "block", F.lit(2).alias("part"), "place", "role", "text", "tokens")
    # the turns before a block that may be history; the system turn comes by itself
    reach = F.floor((F.col("place") + history) / BLOCK)
    carried = said.where((reach > F.col("block")) & ((F.col("place") > 0) | (F.col("role") != "system"))).select(
        "conv_id", F.explode(F.sequence(F.col("block") + 1, reach)).alias("block"), F.lit(1).alias("part"), "place", "role", "text", "tokens")
    whole = sizes.groupBy(F.col("conv_id").alias("c_")).agg(F.sum("n").alias("n"))
    first = said.where("place = 0 and role = 'system'").join(whole, F.col("conv_id").eqNullSafe(F.col("c_")))
    heads = first.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"), "place", "role", "text", "tokens")
    heads = heads.select("conv_id", "block", F.when(F.col("block") == 0, 0).otherwise(-1).alias("part"), "place", "role", "text", "tokens")
    everything = heads.unionByName(carried).unionByName(said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            unit, system, before, turns = None, None, [], []

            def done() -> Iterator[dict]:
                # the system turn is among the turns of the first block
                for w in block_windows(system, before, turns[1:] if system and system[3] else turns, budget, history):
                    yield {"conv_id": unit[0], "block": unit[1], **w}

            for batch in batches:
                for conv, block, part, role, text, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "part", "role", "text", "tokens")), strict=True):
                    if unit != (conv, block):
                        if unit is not None:
                            yield from done()
                        unit, system, before, turns = (conv, block), None, [], []
                    if part <= 0:
                        system = (role, text, tokens, part == 0)
                    else:
                        (before if part == 1 else turns).append((role, text, tokens))
            if unit is not None:
                yield from done()

        out, size = [], 0
        for w in made():
            out.append(w)
            size += len(w["text"])
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, _WINDOW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _WINDOW)

    order = ["conv_id", "block", "part", "place"]
    return everything.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(run, _WINDOW_SQL)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its windows in order; nothing but running hashes is kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, state = None, None

    def closed() -> tuple:
        return (now[0], state["turns"], state["said"].hexdigest(), state["loss"], state["learned"].hexdigest(), state["chars"], state["windows"])

    for batch in batches:
        rows = []
        for conv, text, new_from, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "new_from", "loss")), strict=True):
            if now != (conv,):
                if now is not None:
                    rows.append(closed())
                now, state = (conv,), {"turns": 0, "said": sha256(), "loss": 0, "learned": sha256(), "chars": 0, "windows": 0}
            for role, said, _, _ in turns_of(text[new_from:]):
                state["turns"] += 1
                state["said"].update(f"{role}\n{said}\n".encode())
            for span in loss:
                target = unescaped(text[span["start"]:span["end"]])
                state["loss"] += len(target)
                state["learned"].update(target.encode())
            state["chars"] += len(text)
            state["windows"] += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(), kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows."""
    kept = formatted.select("conv_id", "block", "window", "text", "new_from", "loss")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op7_chat_windows(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    ship(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    kind = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    own = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], kind)
    return digests(windows(rows.unionByName(own), vocabulary("byte_bpe_50k.json")))
