"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time with more turns. Every conversation gets a rolling hash over its
turns; conversations whose full hash is a shorter prefix of another one go (an anti-join), and of equal ones the
smallest conv_id stays. What remains is rendered turn by turn.

The rolling hash of a prefix is the exclusive or of 128-bit hashes of (place, turn), kept by a window function: linear in
the turns. Only hashes travel until the survivors are known; prefix hashes are made distinct before they are
joined, so a first turn that a third of all conversations share is one row.

Defined cases: rows with a null conv_id or without any role and text are ignored; a null role or text is empty; repeated
rows of a turn count once; turns are ordered by turn (nulls first), then role, then md5 of the text; an empty table gives
an empty result; further columns are ignored. A conversation is rendered as one row, so its text must fit
one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(chats: DataFrame) -> DataFrame:
    rows = chats.where("conv_id is not null and (role is not null or text is not null)")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def maximal(chats: DataFrame) -> DataFrame:
    """conv_ids of the conversations that neither prefix a longer one nor repeat an equal one with a smaller id."""
    # The length of the role comes first, so that no role and text read like another role and text.
    turn = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    slim = _turns(chats).select("conv_id", "turn", "role", F.md5("text").alias("t"), turn.alias("h")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "t")
    each = slim.select("conv_id", "h", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    # The window above sorts by conv_id and turn already; k keeps that order.
    by_place = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("conv_id", "k", "n", *[F.bit_xor(F.xxhash64(F.lit(seed), "k", "h")).over(by_place).alias(f"p{seed}") for seed in (1, 2)])
    prefix = ["k", "p1", "p2"]
    whole = each.where("k = n").groupBy(*prefix).agg(F.min("conv_id").alias("conv_id"))
    shorter = each.where("k < n").select(*prefix).distinct()
    return whole.join(shorter, prefix, "left_anti").select("conv_id")


def render(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    turns = _turns(chats).join(maximal(chats), "conv_id", "left_semi")
    # A set, so repeated rows of a turn are one already where they are read.
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", F.md5("text").alias("t"), "text"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE + "\n"))), "")
    return listed.select("conv_id", F.size("l").cast("long").alias("n_turns"), body.alias("rendered"))


ORACLE = f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           where conv_id is not null and (role is not null or text is not null)),
c as (select conv_id, list(struct_pack(r := role, x := text) order by turn nulls first, role, md5(text)) l from t group by 1),
one as (select min(conv_id) conv_id, l from c group by l),
p as (select distinct l[1:k] l from (select l, unnest(range(1, len(l))) k from one))
select conv_id, len(l)::bigint n_turns,
  array_to_string(list_transform(l, lambda m: '{OPEN}' || m.r || chr(10) || m.x || '{CLOSE}' || chr(10)), '') rendered
from one where l not in (select l from p)"""
