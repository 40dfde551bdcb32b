"""URL filters: rules of hosts and paths, and a path-template tree that carries their labels over to other URLs.

URLs that a rule fits are labelled by it. All URLs of a host make a tree of path templates, built from the root down:
numbers and hexadecimal ids within segments become #, and of a node's segments those stay that hold a fair share of its
URLs, so that a node has a bounded number of branches; the others become one wildcard branch. Branches of a node are
then compared with what those like them hold together: if their shares of blocked, allowed and unlabelled URLs, and of
URLs that end there, differ by no more than chance makes likely, they are merged to one. A template is rejected if, of
the labelled URLs that end in it, a share that is smoothed for small numbers is blocked, and if the labelled ones
aren't fewer than the others; URLs of a rejected template that no rule fits are blocked.

DataFrame functions alone. Each level of the tree aggregates over the distinct generalised paths, combining before the
shuffle, and what is collected from a node is no more than its bounded branches. Joins have distinct keys on one side, so
that a host with any share of the rows is split by the adaptive join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.session import cut, scratch

#: (action, host and path): the rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Segments of a template; the last one holds the whole rest of a longer path.
DEPTH = 6
#: A segment stays a branch with one of so many URLs of its node, and with at least LEAST of its own.
FANOUT, LEAST = 32, 2
#: Branches merge if each share is within so many squared standard deviations, and one URL, of what they hold together.
SQUARED = 9.0
#: A template is rejected from this smoothed percentage of blocked ones among its labelled URLs on.
PURITY = 90
_VARIABLE = "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{16,}|[0-9]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z alone) and the path of a URL, both empty for null and where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(action, rule) of the longest rule that fits: its host is the URL's or a domain above it, and the path starts with its path; or null.

    Rules of the same length are taken in their alphabetical order. They become one CASE, so there shouldn't be thousands.
    """
    out = F.when(F.lit(False), F.struct(F.lit("").alias("action"), F.lit("").alias("rule")))
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + start))
        out = out.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule")))
    return out


def generalised(path: Column) -> Column:
    """The path with # for numbers and long hexadecimal ids, and without the signs that templates use."""
    return F.regexp_replace(F.replace(F.replace(path, F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C")), _VARIABLE, "#")


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, action, rule, form) of each row of pages(page_id, url); form is the generalised path."""
    host, path = host_and_path(F.col("url").cast("string"))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    told = own.withColumn("told", rule_of(F.col("host"), F.col("path"), rules))
    return told.select("page_id", "host", "path", F.col("told.action").alias("action"), F.col("told.rule").alias("rule"), generalised(F.col("path")).alias("form"))


def _similar(x: str, of: str, total: str, n: str = "n") -> Column:
    """Whether x of n differs from the share of of total by no more than chance makes likely."""
    x_, of_, total_, n_ = (F.col(c).cast("double") for c in (x, of, total, n))
    apart = x_ * total_ - n_ * of_
    return apart * apart <= F.lit(SQUARED) * n_ * of_ * (total_ - of_) + total_ * total_


def _branches(active: DataFrame) -> DataFrame:
    """(host, template, segment, name) of the segments that stay branches of their node, under the name of those they are merged with.

    active: (host, template, segment, next, n, blocked, allowed) of the paths that go on below their node.
    """
    ends, varies = F.when(F.col("next").isNull(), F.col("n")), F.when(F.contains("next", F.lit("#")), F.col("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    children = active.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")), total(ends).alias("ends"), total(varies).alias("varies"))
    nodes = children.groupBy("host", "template").agg(F.sum("n").alias("all"))
    frequent = children.where(F.col("n") >= LEAST).join(nodes, ["host", "template"]).where(F.col("n") * FANOUT >= F.col("all"))
    none, rest = F.col("n") - F.col("blocked") - F.col("allowed"), F.col("n") - F.col("ends") - F.col("varies")
    label = F.when((F.col("blocked") >= F.col("allowed")) & (F.col("blocked") >= none), "blocked").when(F.col("allowed") >= none, "allowed").otherwise("none")
    shape = F.when((F.col("ends") >= F.col("varies")) & (F.col("ends") >= rest), "ends").when(F.col("varies") >= rest, "varies").otherwise("goes on")
    alike = Window.partitionBy("host", "template", "label", "shape")  # FANOUT rows at most
    pooled = frequent.withColumn("label", label).withColumn("shape", shape).withColumns({f"all_{c}": F.sum(c).over(alike) for c in ("n", "blocked", "allowed", "ends")})
    tested = pooled.withColumn("same", _similar("blocked", "all_blocked", "all_n") & _similar("allowed", "all_allowed", "all_n") & _similar("ends", "all_ends", "all_n"))
    merged = F.array_join(F.sort_array(F.collect_set(F.when(F.col("same"), F.col("segment"))).over(alike)), "|")
    return tested.select("host", "template", "segment", F.when(F.col("same"), merged).otherwise(F.col("segment")).alias("name"))


def tree(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(host, form, template, n, blocked, allowed) of each distinct generalised path: its template, and its URLs, labelled and all.

    In a template, * is a wildcard for one segment, names with | between them are merged branches, # stands for a number
    or an id.
    """
    spark = pages.sparkSession
    label = lambda action: F.count_if(F.col("action") == action)
    paths = parsed(pages, rules).groupBy("host", "form").agg(F.count("*").alias("n"), label("block").alias("blocked"), label("allow").alias("allowed"))
    segments = F.split("form", "/", DEPTH + 1)  # the first one, before the leading slash, is empty
    with scratch(spark) as write:
        paths = write(paths.withColumn("template", F.lit("")))
        deepest = paths.agg(F.max(F.size(segments) - 1)).first()[0] or 0
        for level in range(1, deepest + 1):
            here = paths.withColumn("segment", F.get(segments, F.lit(level)))
            active = here.where("segment is not null").withColumn("next", F.get(segments, F.lit(level + 1)))
            grown = here.join(_branches(active), ["host", "template", "segment"], "left")
            step = F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))
            paths = write(grown.select("host", "form", "n", "blocked", "allowed", F.when(F.col("segment").isNull(), F.col("template")).otherwise(step).alias("template")))
        return cut(paths.select("host", "form", "template", "n", "blocked", "allowed"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, template, n, blocked, allowed, rejected) of the templates of tree()."""
    each = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed")))
    told = F.col("blocked") + F.col("allowed")
    return each.withColumn("rejected", ((F.col("blocked") + 1) * 100 >= (told + 2) * PURITY) & (told * 2 >= F.col("n")))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages(page_id, url).

    verdict: that of the rule, or else block if the URL's template is rejected and allow if not. A null URL, and one
    without ://, has an empty host and path, like any other host. Repeated rows are judged each, and count each; an empty
    table gives no row, and other columns aren't read.
    """
    paths = tree(pages, rules)
    rejected = paths.join(templates(paths).where("rejected").select("host", "template"), ["host", "template"]).select("host", "form", F.lit(True).alias("rejected"))
    each = parsed(pages, rules).join(rejected, ["host", "form"], "left")
    verdict = F.coalesce("action", F.when(F.col("rejected"), F.lit("block")), F.lit("allow"))
    return each.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _oracle() -> str:
    """The same tree in SQL, a few tables for each level."""
    parts = [r"""own as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
split as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from own),
told as (select *, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/' when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end rule,
  regexp_replace(replace(replace(path, '*', '%2A'), '|', '%7C'), '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{16,}|[0-9]+', '#', 'g') form from split),
p0 as (select host, form, count(*) n, count(*) filter (rule in ('net/', 'example.com/de/')) blocked, count(*) filter (rule in ('example.net/en/', 'org/fr/')) allowed,
  '' template from told group by host, form)"""]
    piece = lambda k: f"string_split(form, '/')[{k + 1}]" if k < DEPTH else f"case when len(string_split(form, '/')) > {k} then array_to_string(string_split(form, '/')[{k + 1}:], '/') end"
    near = lambda x: f"pow(cast({x} * sum(n) over w as double) - cast(n * sum({x}) over w as double), 2) <= 9.0 * n * (sum({x}) over w) * (sum(n) over w - sum({x}) over w) + pow(sum(n) over w, 2)"
    for k in range(1, DEPTH + 1):
        parts.append(f"""a{k} as materialized (select *, {piece(k)} seg, {piece(k + 1) if k < DEPTH else 'null'} following from p{k - 1}),
c{k} as (select host, template, seg, sum(n) n, sum(blocked) blocked, sum(allowed) allowed, coalesce(sum(n) filter (following is null), 0) ends,
    coalesce(sum(n) filter (contains(following, '#')), 0) varies, sum(sum(n)) over (partition by host, template) whole from a{k} where seg is not null group by host, template, seg),
k{k} as (select *, case when blocked >= allowed and blocked >= n - blocked - allowed then 1 when allowed >= n - blocked - allowed then 2 else 3 end label,
    case when ends >= varies and ends >= n - ends - varies then 1 when varies >= n - ends - varies then 2 else 3 end shape from c{k} where n >= 2 and n * 32 >= whole),
s{k} as (select *, {near('blocked')} and {near('allowed')} and {near('ends')} same from k{k} window w as (partition by host, template, label, shape)),
b{k} as (select host, template, seg, case when same then string_agg(case when same then seg end, '|' order by seg) over (partition by host, template, label, shape) else seg end as name from s{k}),
p{k} as materialized (select a.host, form, n, blocked, allowed, case when a.seg is null then a.template else a.template || '/' || coalesce(name, '*') end template
  from a{k} a left join b{k} b on a.host = b.host and a.template = b.template and a.seg = b.seg)""")
    parts.append(f"""bad as (select host, template from p{DEPTH} group by host, template
  having (sum(blocked) + 1) * 100 >= (sum(blocked) + sum(allowed) + 2) * 90 and (sum(blocked) + sum(allowed)) * 2 >= sum(n)),
paths as (select host, form from p{DEPTH} semi join bad using (host, template))""")
    return "with " + ",\n".join(parts) + """
select page_id, t.host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when p.host is not null then 'block' else 'allow' end verdict
from told t left join paths p on t.host = p.host and t.form = p.form"""


ORACLE = _oracle()
