"""Conversation history: carried anchors, compacted turns, hints and earlier sources."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import followup
from corpusloom.functions.text import blank_to_null, clean_inline, clip, compact
from corpusloom.operators.ranking import best_per_key, numbered, placed, top_k

BLOCK = 1024


def _in_blocks(turns: DataFrame, frame: int, block: int) -> DataFrame:
    """Cut conversations into blocks of turns; the turns just before a block are copied in as context.

    ``turn`` is the 0-based position in its conversation, so one very long conversation spreads over many tasks.
    """
    own = F.floor(F.col("turn") / block).cast("long")
    near_end = F.col("turn") % block >= block - frame
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return turns.withColumn("_block", F.explode(blocks)).withColumn("_context", F.col("_block") != own)


def carry_anchors(turns: DataFrame, frame: int = fv.HISTORY_TURNS, block: int = BLOCK, sources: DataFrame | None = None,
                  last: int = fv.CLIENT_SOURCE_LIMIT) -> DataFrame:
    """Each user turn with the newest anchors of the user turns before it, and the resolved question.

    ``turns``: conv_id, turn, role, content. Any role counts towards the frame. Where no turn before names an anchor, the
    texts of the ``last`` sources given before the turn do (``sources``: conv_id, turn, position, text), the oldest of them first.
    """
    window = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(-frame, -1)
    own = followup.anchors(F.col("content"))
    size = max(block, frame)
    rows = _in_blocks(turns, frame, size).withColumn("current", own)
    user = F.col("role") == "user"
    newest = [
        F.last(F.when(user, F.col(f"current.{f}")), ignorenulls=True).over(window).alias(f) for f in followup.ANCHORS
    ]
    seen = rows.select("conv_id", "turn", "role", "content", "current", "_context", "_block", *newest)
    kept = seen.filter(user & ~F.col("_context")).withColumn("previous", F.struct(*followup.ANCHORS))
    if sources is not None:
        kept = _with_sources(kept, sources_so_far(sources, last, size), size).withColumn(
            "previous", fill_from_sources(F.col("previous"), F.coalesce("given", F.array().cast(f"array<{_ANCHORS}>"))))
    return kept.select("conv_id", "turn", "content", followup.resolve(
        F.col("content"), F.col("current"), F.col("previous")).alias("resolved"))


_ANCHORS = "struct<" + ", ".join(f"{f}: string" for f in followup.ANCHORS) + ">"


def sources_so_far(sources: DataFrame, last: int = fv.CLIENT_SOURCE_LIMIT, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, given): after every turn with sources, the anchors of the last ``last`` sources so far, oldest first."""
    named = sources.select("conv_id", F.col("turn").alias("_at"), "position", followup.anchors(F.col("text")).alias("anchors"))
    dense = placed(named, ["conv_id"], [F.col("_at"), F.col("position")]).withColumn("turn", F.col("place") - 1)
    window = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(1 - last, 0)
    held = _in_blocks(dense, last, max(block, last)).withColumn("given", F.collect_list("anchors").over(window)).filter(~F.col("_context"))
    return held.groupBy("conv_id", F.col("_at").alias("turn")).agg(F.max_by("given", "place").alias("given"))


def _with_sources(rows: DataFrame, given: DataFrame, block: int) -> DataFrame:
    """As-of join: ``given`` of the newest turn before each row.

    Inside a block of turns it is a running value; what a block begins with is the last value of the blocks before it.
    """
    own = F.floor((F.col("turn") + 1) / block).cast("long")  # sources of a turn count from the next turn on
    marks = given.select("conv_id", own.alias("_block"), F.col("turn").alias("_turn"), "given")
    closing = marks.groupBy("conv_id", "_block").agg(F.max_by("given", "_turn").alias("_close"))
    every = rows.select("conv_id", "_block").distinct().join(closing, ["conv_id", "_block"], "full")
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opening = every.withColumn("_open", F.last("_close", ignorenulls=True).over(earlier)).drop("_close")
    both = rows.withColumn("_turn", F.col("turn").cast("double")).unionByName(
        marks.select("conv_id", "_block", (F.col("_turn") + 0.5).cast("double").alias("_turn"), "given"), allowMissingColumns=True)
    running = Window.partitionBy("conv_id", "_block").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_given", F.last("given", ignorenulls=True).over(running)).filter(F.col("turn").isNotNull())
    return seen.join(opening, ["conv_id", "_block"], "left").withColumn("given", F.coalesce("_given", "_open")).drop("_given", "_open", "_turn")


def fill_from_sources(previous: Column, per_text: Column) -> Column:
    """History anchors, else of every field the first in the anchors of earlier sources."""
    def first_of(field):
        return F.get(F.filter(F.transform(per_text, lambda a: a[field]), lambda v: v.isNotNull()), F.lit(0))

    first = {f: first_of(f) for f in followup.ANCHORS}
    use_history = followup.any_anchor(previous)
    return F.struct(*[F.when(use_history, previous[f]).otherwise(first[f]).alias(f) for f in followup.ANCHORS])


def _frame(turns: DataFrame, frame: int, block: int) -> DataFrame:
    """Each turn with the array of the turns before it, at most ``frame`` of them."""
    window = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(-frame, -1)
    rows = _in_blocks(turns, frame, max(block, frame))
    item = F.struct("turn", "role", "content")
    return rows.withColumn("before", F.collect_list(item).over(window)).filter(~F.col("_context")).select(
        "conv_id", "turn", "role", "content", "before")


def compact_history(turns: DataFrame, frame: int = fv.HISTORY_TURNS, max_chars: int = fv.HISTORY_MAX_CHARS,
                    block: int = BLOCK) -> DataFrame:
    """The bounded history every turn would see: last turns, cut texts, newest first under one budget."""
    # cut the texts before they are copied into frames; the rest of a long turn is never needed
    cap = max(80, max_chars // 2)
    limit = F.when(F.col("role") == "assistant", min(fv.HISTORY_ASSISTANT_CHARS, cap)).otherwise(min(fv.HISTORY_USER_CHARS, cap))
    short = turns.withColumn("content", compact(F.col("content"), limit))
    framed = _frame(short, frame, block)
    talk = F.filter("before", lambda t: t["role"].isin("user", "assistant") & (t["content"] != ""))
    newest_first = F.reverse(talk)

    def add(state, turn):
        room = F.lit(max_chars) - state["used"]
        text = clip(turn["content"], room)
        kept = F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), text.alias("content"))
        return F.when(room <= 0, state).otherwise(F.struct(
            (state["used"] + F.length(text)).alias("used"), F.concat(F.array(kept), state["items"]).alias("items")))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<turn: bigint, role: string, content: string>>").alias("items"))
    return framed.select("conv_id", "turn", F.aggregate(newest_first, start, add)["items"].alias("history"))


def conversation_hint(history: Column, max_chars: int = fv.HINT_MAX_CHARS) -> Column:
    label = lambda t: F.when(t["role"] == "user", "User: ").otherwise("Assistant summary: ")
    lines = F.transform(history, lambda t: F.concat(label(t), t["content"]))
    return F.when(F.size(history) == 0, fv.NO_HISTORY_HINT).otherwise(compact(F.array_join(lines, "\n"), max_chars))


def client_history(turns: DataFrame, greeting: str = "", frame: int = fv.HISTORY_TURNS) -> DataFrame:
    """The chat client's own history: greeting and failed turns dropped, source lines cut from answers.

    ``turns``: conv_id, turn, role, content and optionally finish_reason.
    """
    if "finish_reason" not in turns.columns:
        turns = turns.withColumn("finish_reason", F.lit(None).cast("string"))
    answer = F.col("role") == "assistant"
    usable = (
        (clean_inline(F.col("content")) != "") & F.col("role").isin("user", "assistant")
        & ~(answer & (F.col("content") == greeting)) & ~(answer & F.coalesce(F.col("finish_reason") == "error", F.lit(False)))
    )
    recent = top_k(turns.filter(usable), ["conv_id"], [F.desc("turn")], frame, name="_r")
    lines = F.filter(F.transform(F.split("content", "\n+"), clean_inline), lambda s: s != "")
    meaningful = F.slice(F.filter(lines, lambda s: ~s.rlike(fv.HISTORY_SOURCE_LINE)), 1, 6)
    picked = F.coalesce(blank_to_null(F.array_join(meaningful, " ")), F.col("content"))
    text = F.when(answer, compact(picked, fv.HISTORY_ASSISTANT_CHARS)).otherwise(compact(F.col("content"), fv.HISTORY_USER_CHARS))
    shown = recent.select("conv_id", "turn", "role", text.alias("content")).filter(F.col("content") != "")
    return numbered(shown, ["conv_id"], [F.col("turn")], "position")


def prior_sources(sources: DataFrame, last: int = fv.CLIENT_SOURCE_LIMIT) -> DataFrame:
    """Last distinct sources of a conversation's answers, oldest of them first.

    ``sources``: conv_id, turn, position, page_id, url, source_type, space, title.
    """
    some_id = F.coalesce(*[blank_to_null(F.col(c)) for c in ("url", "page_id", "title")]).isNotNull()
    key = F.coalesce(
        blank_to_null(F.col("page_id")), blank_to_null(F.col("url")),
        F.concat_ws(":", *[F.coalesce(c, F.lit("undefined")) for c in ("source_type", "space", "title")]))
    newest = best_per_key(sources.filter(some_id).withColumn("key", key), ["conv_id", "key"], [-F.col("turn"), -F.col("position")])
    recent = top_k(newest, ["conv_id"], [F.desc("turn"), F.desc("position")], last, name="_r")
    return numbered(recent.drop("_r", "key"), ["conv_id"], [F.col("turn"), F.col("position")], "source_no")
