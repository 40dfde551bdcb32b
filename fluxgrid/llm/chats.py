"""Chat formatting: logged conversations that are prefixes of longer ones collapse, and the rest is rendered.

Logs that are written after each turn hold a conversation many times, each time one turn longer. Every turn gets a hash
of its place, role and text, and a running sum of these over a conversation, kept twice with different seeds, stands
for each of its prefixes; two prefixes that differ share both sums in one of 2^128 cases. A conversation whose whole
equals a proper prefix of another one goes, by an anti-join with the distinct prefixes; of equal conversations the one
with the smallest id stays. members() tells which one each of them went into. DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.session import cut, scratch

#: How a turn is rendered; {role} and {text} stand for its columns.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _hash(seed: int) -> Column:
    """A hash of a turn's place, role and text; a null is none of the strings."""
    parts = (x for c in ("role", "text") for x in (F.isnull(c), F.coalesce(c, F.lit(""))))
    return F.xxhash64("_at", *parts, F.lit(seed)).cast("decimal(38,0)")


def _own(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))


def turns(conversations: DataFrame) -> DataFrame:
    """The turns with their place _at in the conversation from 1 on, and the hash _prefix of the turns up to theirs.

    Turns are ordered by turn, then role and text, nulls first; a repeated row is a turn of its own. Rows without a
    conv_id aren't here: see alone().
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = _own(conversations).where("conv_id is not null").withColumn("_at", F.row_number().over(order).cast("bigint"))
    return placed.withColumn("_prefix", F.struct(F.sum(_hash(1)).over(so_far).alias("a"), F.sum(_hash(2)).over(so_far).alias("b")))


def alone(conversations: DataFrame) -> DataFrame:
    """(role, text, _n, n_turns, _prefix) of the distinct rows without a conv_id, with their number: each is a conversation of one turn, as nothing says which others it belongs to."""
    own = _own(conversations).where("conv_id is null").groupBy("role", "text").agg(F.count("*").alias("_n"))
    placed = own.withColumn("_at", F.lit(1).cast("bigint"))
    return placed.select("role", "text", "_n", F.col("_at").alias("n_turns"), F.struct(_hash(1).cast("decimal(38,0)").alias("a"), _hash(2).cast("decimal(38,0)").alias("b")).alias("_prefix"))


def _prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, _all, _prefix): each prefix of each conversation by its turns and hash, and how many turns there are."""
    own = turns(conversations).withColumn("_all", F.count("*").over(Window.partitionBy("conv_id")))
    return own.select("conv_id", F.col("_at").alias("n_turns"), "_all", "_prefix")


def _lasts(prefixes: DataFrame, single: DataFrame) -> DataFrame:
    """(conv_id, n_turns, _prefix, _n) of whole conversations; those without an id come with their number _n."""
    last = prefixes.where("n_turns = _all").select("conv_id", "n_turns", "_prefix", F.lit(1).cast("bigint").alias("_n"))
    return last.union(single.select(F.lit(None).cast("bigint"), "n_turns", "_prefix", "_n"))


def _maximal(prefixes: DataFrame, lasts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, _prefix) of each distinct conversation that prefixes no longer one."""
    proper = prefixes.where("n_turns < _all").select("n_turns", "_prefix").distinct()
    distinct = lasts.groupBy("n_turns", "_prefix").agg(F.min("conv_id").alias("conv_id"), F.sum("_n").alias("n_copies"))
    return distinct.join(proper, ["n_turns", "_prefix"], "left_anti").select("conv_id", "n_turns", "n_copies", "_prefix")


def _members(prefixes: DataFrame, lasts: DataFrame, stays: DataFrame) -> DataFrame:
    named = stays.where("conv_id is not null").select("conv_id")
    reach = prefixes.join(named, "conv_id", "left_semi").groupBy("n_turns", "_prefix").agg(F.min(F.struct(-F.col("_all"), "conv_id")).alias("_best"))
    return lasts.join(reach, ["n_turns", "_prefix"], "left").select("conv_id", F.col("_best.conv_id").alias("kept_id"), F.col("_n").alias("n"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of each conversation that prefixes no longer one; of equal ones, the smallest id stands for all n_copies."""
    prefixes = _prefixes(conversations)
    return _maximal(prefixes, _lasts(prefixes, alone(conversations))).drop("_prefix")


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, kept_id, n) of all conversations: kept_id is the maximal one that it equals or prefixes, the longest and then the one with the smallest id.

    n is 1, or the number of rows without an id that are the same; a kept conversation may be one of those, with a null kept_id.
    """
    prefixes = _prefixes(conversations)
    lasts = _lasts(prefixes, alone(conversations))
    return _members(prefixes, lasts, _maximal(prefixes, lasts))


def rendered(conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_copies, n_collapsed, text) of each maximal conversation, its turns rendered one after the other.

    n_copies: conversations that equal it, itself included. n_collapsed: shorter ones that it stands for, by members().
    A null role or text is rendered as nothing between the template's marks. A row without a conv_id is a conversation
    of one turn with a null conv_id. An empty table gives no row, and columns other than the four named are left out.
    The hashes of all prefixes are written once; texts are read once more, for the conversations that stay.
    """
    start, middle, end = (F.lit(x) for x in template)
    turn = F.concat(start, F.coalesce("role", F.lit("")), middle, F.coalesce("text", F.lit("")), end)
    with scratch(conversations.sparkSession) as write:
        prefixes, single = write(_prefixes(conversations)), write(alone(conversations))
        lasts = write(_lasts(prefixes, single))
        stays = write(_maximal(prefixes, lasts))
        stood = _members(prefixes, lasts, stays).where("kept_id is not null").groupBy(F.col("kept_id").alias("conv_id")).agg(F.sum("n").alias("_stood"))
        named = cut(stays.where("conv_id is not null").drop("_prefix").join(stood, "conv_id"))
        zero = F.lit(0).cast("bigint").alias("n_collapsed")
        others = single.select("_prefix", "n_turns", turn.alias("text"))
        others = cut(stays.where("conv_id is null").join(others, ["_prefix", "n_turns"]).select("conv_id", "n_turns", "n_copies", zero, "text"))
    order = F.struct("turn", "role", "text", turn.alias("_turn"))  # as turns() has it
    whole = _own(conversations).join(named, "conv_id").groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), (F.first("_stood") - F.first("n_copies")).alias("n_collapsed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["_turn"]), "").alias("text"),
    )
    return whole.union(others)


ORACLE = """
with rows_ as (select conv_id, turn, role, text, {'role': coalesce(role, chr(1)), 'text': coalesce(text, chr(1))} x,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) r from conversations),
own as (select conv_id, list(x order by turn nulls first, role nulls first, text nulls first) t,
    string_agg(r, '' order by turn nulls first, role nulls first, text nulls first) s
  from rows_ where conv_id is not null group by conv_id union all select null, [x], r from rows_ where conv_id is null),
groups as (select t, any_value(s) s, min(conv_id) conv_id, count(*) n_copies from own group by t),
prefixes as (select g.t, g.s, g.conv_id, g.n_copies, g.t[1:k] p, k from groups g, unnest(range(1, len(g.t) + 1)) u(k)),
proper as (select distinct p from prefixes where k < len(t)),
kept as (select * from groups where t not in (select p from proper)),
best as (select p, arg_min(s, (-len(t), conv_id)) s from prefixes where t in (select t from kept) group by p),
stood as (select b.s, sum(g.n_copies) n from groups g join best b on b.p = g.t group by b.s)
select conv_id, cast(len(t) as bigint) n_turns, n_copies, cast(n - n_copies as bigint) n_collapsed, kept.s as text from kept join stood using (s)
"""
