"""Fixity audit of WARC replicas by Merkle trees.

A replica is a set of archives, each a sequence of records at ascending offsets. A leaf hashes a record; an inner node
hashes its children in order, each with its range of offsets relative to the node's own begin. Which records and nodes
make a node is told by their own hashes: one in FAN of them, on average, is the last of its node. So a record that is
lost or added changes the nodes on its own path, and the hashes of all others stay, though their offsets have moved.

Replicas agree on an archive if its roots do. Where they don't, the audit descends, level by level, only into nodes whose
hash the other replica doesn't have in the same archive. What it reaches at the bottom are the records that differ, and
only these are compared with one another; everything else is intact, as its branch was never entered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.session import cut

#: Children of a node, on average.
FAN = 16
#: Distinct records of an archive, about.
PAGES = 1000
#: Levels above the records at most; each has a FAN-th of the nodes below.
LEVELS = 12
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 response record of a page, as a string; its bytes are UTF-8. A null counts as empty.

    The record's id is a UUID of its page and contents, so that it is the same in each replica.
    """
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    own = F.md5(F.concat_ws("\x1f", F.coalesce(page_id.cast("string"), F.lit("")), url, html).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(own, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def listed(pages: DataFrame, copy: str | None = None) -> DataFrame:
    """(block, page_id, url, length, digest, copies) of pages(page_id, url, html) as records, equal ones in one row.

    block: the page's id by the thousand; that of pages without an id is null. copy: a column that counts a row's copies.
    """
    page_id, url = F.col("page_id").cast("bigint"), F.col("url").cast("string")
    text = record(page_id, url, F.col("html").cast("string"))
    one = pages.select(
        F.floor(page_id / PAGES).cast("bigint").alias("block"), page_id.alias("page_id"), F.coalesce(url, F.lit("")).alias("url"),
        F.octet_length(text).cast("bigint").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"),
        (F.lit(1) if copy is None else F.col(copy)).cast("bigint").alias("copies"),
    )
    return one.groupBy("block", "page_id", "url", "length", "digest").agg(F.sum("copies").alias("copies"))


def archived(records: DataFrame, parts: DataFrame) -> DataFrame:
    """(file_id, page_id, url, digest, position, offset, length, copies): listed() records laid out in archives.

    parts(block, parts): of how many archives each block of ids consists; the records of a block are dealt to them by a
    hash of id and address. Different contents of one id and address lie in one archive, as corrupt ones are told there,
    so that an archive is as large as the most contents that any address has; equal contents are one row. Within an
    archive records are ordered by id, address and digest; copies follow one another. Only digests are shuffled.
    """
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    filed = records.join(parts.withColumnRenamed("block", "_block"), F.col("block").eqNullSafe(F.col("_block")), "left")
    filed = filed.select(F.concat_ws("-", F.coalesce(F.col("block").cast("string"), F.lit("none")), part.cast("string")).alias("file_id"), *records.columns)
    order = Window.partitionBy("file_id").orderBy("page_id", "url", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    return filed.select("file_id", "page_id", "url", "digest", sums(F.col("copies")).alias("position"), sums(F.col("length") * F.col("copies")).alias("offset"), "length", "copies")


def parts_of(*replicas: DataFrame) -> DataFrame:
    """(block, parts) for listed() replicas: as many archives as the largest of them needs."""
    counted = [x.groupBy("block").agg(F.count("*").alias("n")) for x in replicas]
    every = counted[0]
    for more in counted[1:]:
        every = every.union(more)
    return every.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.max("n") / PAGES)).cast("int").alias("parts"))


def leaves(records: DataFrame) -> DataFrame:
    """The lowest nodes (file_id, at, begin, end, hash, page_id, url, digest, length, copies) over archived() records."""
    name = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", F.col("length").cast("string"), F.col("copies").cast("string"), "digest")
    return records.select(
        "file_id", F.col("position").alias("at"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length") * F.col("copies")).alias("end"),
        F.sha2(name.cast("binary"), 256).alias("hash"), "page_id", "url", "digest", "length", "copies",
    )


def grouped(nodes: DataFrame) -> DataFrame:
    """The nodes with up: the place of their parent in the archive, counted by the nodes before that are the last of theirs."""
    last = F.when(F.conv(F.substring("hash", 1, 7), 16, 10).cast("bigint") % FAN == 0, 1).otherwise(0)
    before = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("up", F.coalesce(F.sum(last).over(before), F.lit(0)).cast("bigint"))


def above(nodes: DataFrame) -> DataFrame:
    """The nodes of the next level over grouped() ones."""
    child = F.struct("at", "begin", "end", "hash")
    own = nodes.groupBy("file_id", F.col("up").alias("at")).agg(F.sort_array(F.collect_list(child)).alias("_below"))
    begin = F.element_at("_below", 1)["begin"]
    line = F.transform("_below", lambda x: F.concat_ws(":", (x["begin"] - begin).cast("string"), (x["end"] - begin).cast("string"), x["hash"]))
    return own.select("file_id", "at", begin.alias("begin"), F.element_at("_below", -1)["end"].alias("end"), F.sha2(F.array_join(line, ",").cast("binary"), 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """The levels of an archived() replica's trees, from the records to one root for each archive."""
    levels = [cut(grouped(leaves(records)))]
    while levels[-1].where("at > 0").limit(1).count():
        if len(levels) == LEVELS:  # whatever the hashes are, the root covers all that is left
            levels[-1] = levels[-1].withColumn("up", F.lit(0).cast("bigint"))
        levels.append(cut(grouped(above(levels[-1]))))
    return levels


def _padded(levels: list[DataFrame], size: int) -> list[DataFrame]:
    """The levels with roots above the root, up to a number of levels."""
    while len(levels) < size:
        levels = [*levels, above(levels[-1]).withColumn("up", F.lit(0).cast("bigint"))]
    return levels


def differing(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of both replicas, archived(), after the descent: the records of branches that the other one doesn't have."""
    pair = [tree(ours), tree(theirs)]
    size = max(map(len, pair))
    pair = [_padded(x, size) for x in pair]
    reached = [x[-1] for x in pair]
    for k in range(size - 1, -1, -1):
        alone = [cut(a.join(b.select("file_id", "hash"), ["file_id", "hash"], "left_anti")) for a, b in (reached, reached[::-1])]
        if k:
            marks = [x.select("file_id", F.col("at").alias("up")) for x in alone]
            reached = [side[k - 1].join(mark, ["file_id", "up"], "left_semi") for side, mark in zip(pair, marks, strict=True)]
    return alone[0], alone[1]


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file_id, page_id, url, position, offset, length, status) of each record of ours, and of those that only theirs has.

    status: 'intact', 'corrupt' (theirs has another content for that id and address), 'missing' (theirs lacks the record
    or copies of it), 'extra' (only theirs has it; position and offset are its own there). Both are archived()
    replicas, laid out with the same parts. Copies of a record are rows of their own; where one replica has fewer, the
    last ones are missing or extra. An audit of two empty replicas has no row.
    """
    ours, theirs = cut(ours), cut(theirs)
    here, there = differing(ours, theirs)
    key = ["file_id", "page_id", "url"]
    shape = F.struct("at", "begin", "length", "digest", "copies")
    a = here.groupBy(*key).agg(F.sort_array(F.collect_list(shape)).alias("a"))
    b = there.groupBy(*key).agg(F.sort_array(F.collect_list(shape)).alias("b"))
    both = a.join(b.withColumnsRenamed({k: f"_{k}" for k in key}), F.col("file_id").eqNullSafe(F.col("_file_id")) & F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("url").eqNullSafe(F.col("_url")), "full_outer")
    both = both.select(*(F.coalesce(k, f"_{k}").alias(k) for k in key), F.coalesce("a", F.array().cast(_SHAPES)).alias("a"), F.coalesce("b", F.array().cast(_SHAPES)).alias("b"))
    # Of an id and address: the contents that both have, and by how many copies; others are paired as corrupt, the rest is missing or extra.
    had = lambda x, other: F.aggregate(F.filter(other, lambda y: y["digest"] == x["digest"]), F.lit(0).cast("bigint"), lambda n, y: n + y["copies"])
    alone = lambda own, other: F.flatten(F.transform(own, lambda x: F.transform(
        F.filter(F.sequence(F.lit(0).cast("bigint"), x["copies"] - 1), lambda i: i >= had(x, other)),
        lambda i: F.struct((x["at"] + i).alias("position"), (x["begin"] + i * x["length"]).alias("offset"), x["length"].alias("length")),
    )))
    shared = lambda own, other: F.flatten(F.transform(own, lambda x: F.transform(
        F.filter(F.sequence(F.lit(0).cast("bigint"), x["copies"] - 1), lambda i: i < had(x, other)),
        lambda i: F.struct((x["at"] + i).alias("position"), (x["begin"] + i * x["length"]).alias("offset"), x["length"].alias("length")),
    )))
    told = both.select(*key, shared("a", "b").alias("same"), alone("a", "b").alias("lost"), alone("b", "a").alias("new"))
    paired = F.least(F.size("lost"), F.size("new"))
    marked = lambda rows, status: F.transform(rows, lambda x: F.struct(x["position"].alias("position"), x["offset"].alias("offset"), x["length"].alias("length"), F.lit(status).alias("status")))
    part = lambda c, first: F.slice(c, 1, paired) if first else F.when(F.size(c) > paired, F.slice(c, paired + 1, F.size(c))).otherwise(F.filter(c, lambda x: F.lit(False)))
    rows = F.concat(marked(F.col("same"), "intact"), marked(part("lost", True), "corrupt"), marked(part("lost", False), "missing"), marked(part("new", False), "extra"))
    found = told.select(*key, F.explode(rows).alias("_row")).select(*key, "_row.*")
    whole = ours.join(here.select("file_id", F.col("at").alias("position")), ["file_id", "position"], "left_anti")
    each = whole.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    intact = each.select(*key, (F.col("position") + F.col("_i")).alias("position"), (F.col("offset") + F.col("_i") * F.col("length")).alias("offset"), "length", F.lit("intact").alias("status"))
    return intact.unionByName(found)


_SHAPES = "array<struct<at:bigint,begin:bigint,length:bigint,digest:string,copies:bigint>>"


def audited(pages: DataFrame, others: DataFrame) -> DataFrame:
    """audit() of two tables of pages as replicas."""
    ours, theirs = cut(listed(pages)), cut(listed(others))
    parts = cut(parts_of(ours, theirs))
    return audit(archived(ours, parts), archived(theirs, parts))


def drill(pages: DataFrame) -> DataFrame:
    """A replica of pages with known damage, for a drill, by page_id modulo 997: 5 has another first character, 6 is lost,
    7 is there twice, and 8 and 9 have changed their contents with the same length of record or another."""
    html, left = F.col("html").cast("string"), F.col("page_id") % 997
    hit = (left == 5) & (F.length(html) > 0) & (F.substring(html, 1, 1) != "#")
    other = F.when(hit, F.concat(F.lit("#"), F.substring(html, 2, 2_000_000_000))).when(left == 8, F.reverse(html)).when(left == 9, F.concat(html, F.lit("!"))).otherwise(html)
    stays = pages.withColumn("html", other).where("page_id is null or page_id % 997 <> 6")
    return stays.union(stays.where("page_id % 997 = 7"))


#: The same without trees: records by id and address, and how many of each content both sides have.
ORACLE = r"""
with pages_ as (select page_id, coalesce(url, '') url, coalesce(html, '') html from pages),
other as (select page_id, url, case when page_id % 997 = 5 and html <> '' and html[1] <> '#' then '#' || html[2:] when page_id % 997 = 8 then reverse(html) when page_id % 997 = 9 then html || '!' else html end html
  from pages_ where page_id is null or page_id % 997 <> 6),
both_ as (select 0 r, * from pages_ union all select 1, * from other union all select 1, * from other where page_id % 997 = 7),
one as (select r, page_id, url, md5(concat_ws(chr(31), coalesce(page_id::varchar, ''), url, html)) u, html from both_),
two as (select r, page_id, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] || '>'
  || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) t from one),
three as (select r, page_id, url, octet_length(encode(t))::bigint length, sha256(t) digest, coalesce((page_id // 1000)::varchar, 'none') || '-0' file_id from two),
four as (select *, row_number() over w - 1 as position, coalesce(sum(length) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
  row_number() over (partition by r, file_id, page_id, url, digest order by 1) nth from three window w as (partition by r, file_id order by page_id nulls first, url, digest)),
lost as (select *, row_number() over (partition by file_id, page_id, url order by position) k from (select * from four a where r = 0 and not exists
  (select 1 from four b where b.r = 1 and b.file_id = a.file_id and b.page_id is not distinct from a.page_id and b.url = a.url and b.digest = a.digest and b.nth = a.nth))),
new_ as (select *, row_number() over (partition by file_id, page_id, url order by position) k from (select * from four a where r = 1 and not exists
  (select 1 from four b where b.r = 0 and b.file_id = a.file_id and b.page_id is not distinct from a.page_id and b.url = a.url and b.digest = a.digest and b.nth = a.nth)))
select a.file_id, a.page_id, a.url, a.position, a."offset", a.length,
  case when l.k is null then 'intact' when exists (select 1 from new_ n where n.file_id = l.file_id and n.page_id is not distinct from l.page_id and n.url = l.url and n.k = l.k) then 'corrupt' else 'missing' end status
from four a left join lost l on l.file_id = a.file_id and l.position = a.position where a.r = 0
union all select n.file_id, n.page_id, n.url, n.position, n."offset", n.length, 'extra' from new_ n
where not exists (select 1 from lost l where n.file_id = l.file_id and n.page_id is not distinct from l.page_id and n.url = l.url and n.k = l.k)
"""
