"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns (equal role and equal text) of the two conversations is rendered once as the
prompt; what follows on either side is its completion.  Every rendered turn is a row of its segment with the
character at which it begins and a mask: only assistant turns of a completion are trained on.  Rows keep
conversations of any length whole without gathering one in a task.

Turns fall into blocks of their conversation.  Digests and lengths, not texts, go through the search for the prefix: a
turn's place is its place in the block plus the rows of the blocks before, the prefix ends at the least place at which the
two sides differ.  Texts are dealt once, by block, and meet a small row for their block there.

DataFrame functions only.

Defined cases: a null role renders as ``unknown``, a null text as empty; turns are ordered by turn number (null
first), then role and SHA-256 of the rendered turn, so repeated turn rows stand next to each other and all count; a pair with
one side has no common prefix; two equal conversations are all prompt, with empty completions; a null pair is a pair of its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import shared_table, small

#: Turn numbers to a block: running sums go over blocks first, then within one.
BLOCK = 64
#: A pair, its side and a block without nulls, so that equal keys stay where they are in a join.
PAIR = ("_p", "_pn")
KEY = (*PAIR, "_s", "_b")


def rendered(role: Column, text: Column) -> Column:
    """One turn of the chat template."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def keyed(turns: DataFrame) -> DataFrame:
    """``turns`` with the columns of KEY, its role and its rendered content."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    return turns.select(
        F.coalesce(F.col("pair_id").cast("long"), F.lit(0)).alias("_p"), F.isnull("pair_id").alias("_pn"), (F.col("side") == "rejected").alias("_s"), block.alias("_b"),
        "conv_id", "turn", role.alias("role"), rendered(role, text).alias("content"),
    )


def inside(turns: DataFrame) -> DataFrame:
    """``_i`` and ``_c``: rows and characters before each turn in its block, from ``_h`` (digest) and ``_n`` (characters)."""
    order = Window.partitionBy(*KEY).orderBy(F.col("turn").asc_nulls_first(), "role", "_h")
    return turns.withColumn("_i", F.row_number().over(order) - 1).withColumn("_c", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))


def preferences(turns: DataFrame) -> DataFrame:
    """``turns``: ``pair_id, side ('chosen' or 'rejected'), conv_id, turn, role, text``.

    One row per rendered turn: ``pair_id, conv_id, segment ('prompt', 'chosen', 'rejected'), position`` in the segment,
    ``start`` (its first character there), ``role, content, trained`` and, for the pair, ``n_prompt_turns``.
    """
    rows = keyed(turns)
    digest, chars = F.unhex(F.sha2(F.col("content").cast("binary"), 256)), F.char_length("content").cast("long")
    narrow = inside(shared_table(rows.select(*KEY, "turn", "role", digest.alias("_h"), chars.alias("_n"))))
    # rows and characters of the blocks before each block
    blocks = narrow.groupBy(*KEY).agg(F.count("*").alias("_rows"), F.sum("_n").alias("_chars"))
    earlier = Window.partitionBy(*PAIR, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = shared_table(blocks.select(*KEY, before("_rows").alias("_r0"), before("_chars").alias("_c0")))
    places = narrow.join(blocks, list(KEY)).select(*PAIR, "_s", (F.col("_r0") + F.col("_i")).alias("place"), (F.col("_c0") + F.col("_c")).alias("before"), F.xxhash64("role", "_h").alias("_x"), "_h")
    met = places.groupBy(*PAIR, "place").agg(
        F.count(F.when(~F.col("_s"), 1)).alias("_1"), F.count(F.when(F.col("_s"), 1)).alias("_2"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.min("before").alias("_at"),
    )
    same = (F.col("_1") == 1) & (F.col("_2") == 1) & (F.col("_lo") == F.col("_hi"))
    # a place is in the prefix if it and all before it are the same; the prefix is as long as its characters on either side
    ends = F.min(F.when(~same, F.struct("place", "_at")))
    found = met.groupBy(*PAIR).agg(ends.alias("_e"), F.count("*").alias("_all"))
    found = found.select(*PAIR, F.coalesce("_e.place", "_all").alias("n_prompt_turns"), F.col("_e._at").alias("_lead"))
    here = blocks.join(found, list(PAIR))
    own = inside(rows.withColumn("_h", digest).withColumn("_n", chars)).join(here, list(KEY))
    place, shared = F.col("_r0") + F.col("_i"), F.col("_r0") + F.col("_i") < F.col("n_prompt_turns")
    own = own.where(~(shared & F.col("_s")))
    side = F.when(F.col("_s"), "rejected").otherwise("chosen")
    start = F.col("_c0") + F.col("_c")
    return own.select(
        F.when(~F.col("_pn"), F.col("_p")).alias("pair_id"), "conv_id", F.when(shared, "prompt").otherwise(side).alias("segment"),
        F.when(shared, place).otherwise(place - F.col("n_prompt_turns")).alias("position"), F.when(shared, start).otherwise(start - F.col("_lead")).alias("start"),
        "role", "content", (~shared & (F.col("role") == "assistant")).alias("trained"), "n_prompt_turns",
    )


def examples(segments: DataFrame) -> DataFrame:
    """One row per pair: ``prompt``, ``chosen`` and ``rejected`` texts and the (start, length) spans trained on.

    For training sets whose conversations fit a row; ``preferences`` itself has no such bound.
    """
    def text(segment: str) -> Column:
        mine = F.collect_list(F.when(F.col("segment") == segment, F.struct("position", "content")))
        return F.array_join(F.transform(F.array_sort(mine), lambda x: x["content"]), "").alias(segment)

    def spans(segment: str) -> Column:
        mine = F.collect_list(F.when((F.col("segment") == segment) & F.col("trained"), F.struct("start", F.char_length("content").alias("length"))))
        return F.array_sort(mine).alias(f"{segment}_spans")

    return segments.groupBy("pair_id", "n_prompt_turns").agg(text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made of conversations 2k (chosen) and 2k + 1 (rejected), so that every conversation is in one pair."""
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    return conversations.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(even | F.col("conv_id").isNull(), "chosen").otherwise("rejected").alias("side"), "conv_id", "turn", "role", "text")


def pair_replies(conversations: DataFrame) -> DataFrame:
    """Turns of one pair per conversation: as it is (chosen), and with another last reply (rejected).

    The rejected side has the turns before the conversation's last assistant turn number and then the last assistant turn
    of the neighbour (conversations 2k and 2k + 1 are neighbours), if that has one.  A conversation without assistant turns keeps
    all its turns there, and turns without a number stay on both sides.  Of several assistant turns of the last number, the
    reply is the one of the largest text.
    """
    told = F.when(F.col("role") == "assistant", F.col("turn"))
    # a null conversation has no neighbour and counts as one conversation
    last = conversations.where((F.col("role") == "assistant") & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("_r"))
    ends = conversations.groupBy("conv_id").agg(F.max(told).alias("_cut"), F.max("turn").alias("_max"))
    ends = shared_table(ends.select(F.col("conv_id").alias("_id"), "_cut", "_max"))
    reply = last.where("conv_id is not null").select((F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))).alias("_to"), F.col("conv_id").alias("_from"), F.col("_r.text").alias("_text"))
    swapped = ends.join(reply, F.col("_id") == F.col("_to")).select(
        F.col("_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("_from").alias("conv_id"), F.coalesce("_cut", F.col("_max") + 1, F.lit(0)).alias("turn"), F.lit("assistant").alias("role"), F.col("_text").alias("text"),
    )
    each = conversations.join(small(ends).select("_id", "_cut"), F.col("conv_id").eqNullSafe(F.col("_id")))
    stays = F.col("_cut").isNull() | F.col("turn").isNull() | (F.col("turn") < F.col("_cut"))
    sides = F.explode(F.when(stays, F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen"))))
    return each.select(F.col("conv_id").alias("pair_id"), sides.alias("side"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(swapped)
