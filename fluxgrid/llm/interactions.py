"""Filter interaction audit: what each filter removes in every order of the filters, from counts of which filters fail together.

Each document becomes a mask, a bit for each filter that it fails, and only the counts of masks in each part (of all
documents, of good and of toxic ones) go on. A zeta transform over subsets turns 2^k mask counts into the documents that
each subset of the filters leaves, in k passes. A step of an order is then the difference of two neighbouring subsets,
whatever the number of documents, and a filter's Shapley sum is one of such differences.

The filter for copies needs the table: a document fails it if a smaller doc_id has the same text. Texts stand as SHA-256
digests; each digest's smallest id is found by an aggregation that combines before its shuffle, and joined by id and
digest, so that a text with any number of copies meets in no task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.quality import SPACES
from fluxgrid.session import cut, scratch


@dataclass(frozen=True)
class Filter:
    """A name of one character, and the condition under which a text with its words fails; None: copies of a smaller id's text fail."""

    name: str
    fails: Callable[[Column, Column], Column] | None


FILTERS = (
    Filter("A", lambda text, w: F.size(w) < 50),
    Filter("B", lambda text, w: F.size(F.array_distinct(w)) * F.lit(100).cast("bigint") < F.size(w) * F.lit(65).cast("bigint")),
    Filter("C", lambda text, w: F.length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100).cast("bigint") > F.length(text) * F.lit(5).cast("bigint")),
    Filter("D", lambda text, w: F.rlike(text, F.lit("[#$%&*|]"))),
    Filter("E", None),
)
#: What is counted of each mask, and then of each subset.
COUNTED = ("n", "good", "toxic")


def _words(text: Column) -> Column:
    """The words of a text, which is not null: runs of anything but white space."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner != "", F.split(inner, f"[{SPACES}]+")).otherwise(F.array().cast("array<string>"))


def _flagged(docs: DataFrame, filters: tuple[Filter, ...], part: str) -> DataFrame:
    """(doc_id, part, digest, mask) of each row, without the filter for copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = own.withColumn("words", _words(F.col("text")))
    mask = F.lit(0)
    for k, each in enumerate(filters):
        if each.fails is not None:
            mask = mask + F.when(each.fails(F.col("text"), F.col("words")), F.lit(1 << k)).otherwise(F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail exactly the filters whose bits are set, and how
    many of them labels(doc_id, quality, toxic) has with quality 1 and with toxic 1.

    A null text is empty, and so is a null part. Repeated rows are documents of their own, with the same id and so no
    copies of each other. A row without an id has no label, and is neither a copy nor has any. Of several labels of an
    id, one with the value 1 is enough. An empty table gives no row; other columns aren't read.
    """
    spark = docs.sparkSession
    copies = sum(1 << k for k, each in enumerate(filters) if each.fails is None)
    with scratch(spark) as write:
        flags = write(_flagged(docs, filters, part))
        known = flags.where("doc_id is not null")
        first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
        told = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
        told = told.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        joined = known.join(told, "doc_id", "left").join(first, ["doc_id", "digest"], "left")
        copied = F.when(F.col("first").isNull(), F.lit(copies)).otherwise(F.lit(0))
        false = F.lit(False)
        every = joined.select("part", (F.col("mask") + copied).alias("mask"), F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))
        every = every.unionByName(flags.where("doc_id is null").select("part", "mask", false.alias("good"), false.alias("toxic")))
        return cut(every.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))


def _zeta(counts: DataFrame, k: int) -> DataFrame:
    """(part, n, good, toxic): arrays by subset of filters, as the sum of its bits: the documents that fail none of the subset."""
    of = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: F.coalesce(F.try_element_at("masks", m)[c], F.lit(0).cast("bigint")))
    each = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED))))  # 2^k entries at most
    sums = counts.groupBy("part").agg(each.alias("masks")).select("part", *(of(c).alias(c) for c in COUNTED))
    for b in (1 << i for i in range(k)):
        with_bit = lambda c, b=b: F.transform(c, lambda x, m: x + F.when(m.bitwiseAND(F.lit(b)) != 0, F.get(F.col(c), m - b)).otherwise(F.lit(0)))
        sums = sums.select("part", *(with_bit(c).alias(c) for c in COUNTED))
    # Now each entry counts the masks within its own bits; what a subset leaves are the masks within its complement.
    return sums.select("part", *(F.reverse(c).alias(c) for c in COUNTED))


def survivors(counts: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """(part, filters, n, good, toxic): what each subset of the filters leaves of each part of masks(); filters holds their names in order."""
    k = len(filters)
    names = F.array(*(F.lit("".join(f.name for i, f in enumerate(filters) if s >> i & 1)) for s in range(1 << k)))
    each = F.explode(F.arrays_zip("filters", *COUNTED)).alias("x")
    return _zeta(counts, k).withColumn("filters", names).select("part", each).select("part", F.col("x")["filters"].alias("filters"), *(F.col("x")[c].alias(c) for c in COUNTED))


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each
    part, each order of the filters and each step of it, also where nothing is removed.

    removed: what the step's filter takes of what the ones before it left; redundant: what fails it and is gone already;
    unique_fails: what fails no other filter; good_lost and toxic_lost: removed documents with those labels; shapley: the
    filter's removed, summed over all orders. For nulls, repeated rows and empty tables see masks(). The rows grow with
    the parts and the factorial of the filters, not with the documents.
    """
    k = len(filters)
    full, names = (1 << k) - 1, "".join(f.name for f in filters)
    n = lambda s: F.get("n", F.lit(s))
    removed_in_all = lambda i: sum(
        ((n(s) - n(s | 1 << i)) * F.lit(math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())) for s in range(1 << k) if not s >> i & 1),
        start=F.lit(0).cast("bigint"),
    )
    parts = _zeta(masks(docs, labels, filters, part), k)
    parts = parts.withColumn("shapleys", F.array(*map(removed_in_all, range(k)))).withColumn("orders", F.array(*(F.lit("".join(p)) for p in permutations(names))))
    bit = lambda name: F.get(F.array(*(F.lit(1 << i) for i in range(k))), F.instr(F.lit(names), name) - 1)
    orders = parts.select("part", *COUNTED, "shapleys", F.explode("orders").alias("filter_order"))
    steps = orders.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "name"))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda total, x: total + bit(x))
    steps = steps.withColumn("before", before).withColumn("bit", bit(F.col("name"))).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"),
        (n(0) - F.get("n", F.col("bit")) - lost("n")).alias("redundant"), (F.get("n", F.lit(full) - F.col("bit")) - n(full)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapleys", F.instr(F.lit(names), F.col("name")) - 1).alias("shapley"),
    )


ORACLE = r"""
with own as (select doc_id, coalesce(source, '') part, coalesce(text, '') text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by text) least from own),
failed as (select doc_id, part, case when len(w) < 50 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > least then 16 else 0 end m from split),
told as (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by doc_id),
counts as (select part, m, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from failed left join told using (doc_id) group by part, m),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x, unnest([1, 2, 4, 8, 16]) b),
orders as (select a.x || b.x || c.x || d.x || e.x filter_order, [a.b, b.b, c.b, d.b, e.b] bits from letters a, letters b, letters c, letters d, letters e
  where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps as (select filter_order, cast(s as integer) step, bits[s] b, cast(coalesce(list_sum(bits[1:s - 1]), 0) as integer) gone from orders, unnest([1, 2, 3, 4, 5]) u(s)),
found as (select part, filter_order, step, any_value(b) b,
    cast(coalesce(sum(n) filter (m & (gone | b) = 0), 0) as bigint) kept,
    cast(coalesce(sum(n) filter (m & gone = 0 and m & b != 0), 0) as bigint) removed,
    cast(coalesce(sum(n) filter (m & gone != 0 and m & b != 0), 0) as bigint) redundant,
    cast(coalesce(sum(n) filter (m = b), 0) as bigint) unique_fails,
    cast(coalesce(sum(good) filter (m & gone = 0 and m & b != 0), 0) as bigint) good_lost,
    cast(coalesce(sum(toxic) filter (m & gone = 0 and m & b != 0), 0) as bigint) toxic_lost
  from counts, steps group by part, filter_order, step)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, b) as bigint) shapley from found
"""
