"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a condition on counts of a text. Two things are estimated on a hashed sample, in one aggregation: the share
of texts that each rule rejects, and its cost, from the lengths of the sampled texts and what each count takes for a
character, word or line. The rules then stand in one CASE expression in falling order of rejection per cost, so that
most bad texts meet a cheap rule first, and dear counts are made only of what is left. The order depends on the table
alone, not on clocks or on how rows are dealt; it changes the cost and the rule that is named, never what is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, about, of the sample that orders the rules: those whose id and text have the smallest hashes. No row is kept or rejected by it.
SAMPLE_ROWS = 2000
#: White space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a lambda's argument is never computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain(text: Column) -> Column:
    """The text with single spaces' place for any white space; empty for null."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def _number_of(text: Column, signs: str) -> Column:
    """How many characters of the text are among the signs."""
    text = F.coalesce(text, F.lit(""))
    rest = text
    for c in signs:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("bigint")


def words(text: Column) -> Column:
    """The words of a text: runs of anything but white space. None for null."""
    return F.array_remove(F.split(_plain(text), " "), "")


def lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")


def n_repeat_words(w: Column) -> Column:
    """How many of the words stand in windows of five words that the text has twice or more.

    Where the hashes of all windows differ, so do the windows, and there is none; this settles most texts. Otherwise
    the windows whose hash another one has are compared themselves. The places of those that are found twice, in
    ascending order, cover five words each, or as many as lie before the next place.
    """

    def twice(pairs: Column) -> Column:
        """The places, in ascending order, of those (value, place) whose value another one has."""
        return _let(F.sort_array(pairs), lambda p: F.sort_array(F.transform(
            F.filter(
                F.transform(p, lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (((k > 0) & (F.get(p, F.greatest(k - 1, F.lit(0)))["v"] == x["v"]))
                     | F.coalesce(F.get(p, k + 1)["v"] == x["v"], F.lit(False))).alias("twice"),
                )),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )))

    def hashes(w: Column) -> Column:
        """The hash of each window; windows that the text's end cuts off have none."""
        return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(
            x, *(F.get(h, i + k) for k in range(1, WINDOW))
        )), 1, F.size(h) - (WINDOW - 1)))

    def covered(at: Column) -> Column:
        width = F.lit(WINDOW)
        return F.aggregate(
            F.transform(at, lambda i, k: F.least(width, F.coalesce(F.get(at, k + 1) - i, width))), F.lit(0), lambda a, x: a + x
        )

    def repeated(h: Column) -> Column:
        # get() and not slice(), which copies the whole array whenever it is called
        window = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(WINDOW)))
        alike = twice(F.transform(h, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
        return _let(twice(F.transform(alike, lambda i: F.struct(window(i).alias("v"), i.alias("i")))), covered)

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(
        _let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
    ).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    return _let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


@dataclass(frozen=True)
class Rule:
    """Rejects a text where the condition on its counts holds; counts are computed only if the rule is reached."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]
    #: The counts that the condition is on, beside n_words, which all rules share.
    counts: tuple[str, ...] = ()


#: Each count from a text and its words.
COUNTS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("bigint"),
    "word_chars": lambda t, w: F.length(F.replace(_plain(t), F.lit(" "), F.lit(""))).cast("bigint"),
    "n_symbols": lambda t, w: _number_of(t, SYMBOLS),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_lines": lambda t, w: F.size(lines(t)).cast("bigint"),
    "n_shouts": lambda t, w: _number_of(t, "!?"),
}
#: What each count takes, in nanoseconds for (a text, a character, a word, a line): rounded measurements on one core.
COSTS: dict[str, tuple[float, float, float, float]] = {
    "n_words": (50, 0, 0, 0),
    "word_chars": (200, 4, 0, 0),
    "n_symbols": (200, 8, 0, 0),
    "n_dup_lines": (200, 1, 0, 150),
    "n_repeat_words": (500, 0, 250, 0),
    "n_lines": (200, 1, 0, 100),
    "n_shouts": (200, 2, 0, 0),
}
#: The counts that the query gives for every text.
GIVEN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = (
    Rule("few_words", lambda c: c("n_words") < 10),
    Rule("repeats", lambda c: c("n_repeat_words") * 100 > c("n_words") * 20, ("n_repeat_words",)),
)
#: Beside the base rules: texts of signs, shouting, the same lines again and again, and words of odd length.
RULES = (
    *BASE,
    Rule("symbols", lambda c: c("n_symbols") * 100 > c("n_words") * 30, ("n_symbols",)),
    Rule("shouting", lambda c: c("n_shouts") * 100 > c("n_words") * 60, ("n_shouts",)),
    Rule("same_lines", lambda c: (c("n_lines") >= 8) & (c("n_dup_lines") * 100 > c("n_lines") * 60), ("n_lines", "n_dup_lines")),
    Rule("word_length", lambda c: (c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 20), ("word_chars",)),
)


def _of(text: Column, body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """body of the counts of a text; its words are split once, and each count is computed where body uses it."""
    return _let(words(text), lambda w: body(lambda name: COUNTS[name](text, w)))


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """(text) of about so many rows of docs, or all of a smaller table: those whose id and text hash low, however rows are dealt."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    total, steps = own.count(), 1 << 30
    if total <= rows:
        return own.select("text")
    return own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < int(steps * rows / total)).select("text")


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share of the sample that it rejects, its nanoseconds for a text there), by falling rejection per cost.

    Ties, and an empty sample, keep the order given. Nothing but these figures comes to the driver.
    """
    text = F.col("text")
    size = F.coalesce(F.length("text"), F.lit(0))
    found = sampled(docs, sample_rows).agg(
        *(F.count_if(_of(text, rule.rejects)).alias(f"r{k}") for k, rule in enumerate(rules)),
        F.count("*").alias("n"), F.avg(size).alias("chars"), F.avg(_of(text, lambda c: c("n_words"))).alias("words"), F.avg(F.size(lines(text))).alias("lines"),
    ).first()
    if not found.n:
        return [(rule, 0.0, 0.0) for rule in rules]
    lengths = (1.0, found.chars, found.words, found.lines)
    cost = lambda rule: sum(c * n for name in ("n_words", *rule.counts) for c, n in zip(COSTS[name], lengths, strict=True))
    each = [(rule, found[f"r{k}"] / found.n, cost(rule)) for k, rule in enumerate(rules)]
    return sorted(each, key=lambda x: -x[1] / x[2])


def verdict(rules: list[Rule], count: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or null: one CASE, whose later branches run only if they are reached."""
    first, *rest = rules
    out = F.when(first.rejects(count), F.lit(first.name))
    for rule in rest:
        out = out.when(rule.rejects(count), F.lit(rule.name))
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, name: str = "rejected_by") -> DataFrame:
    """docs with a column of the given name, in place of one that it has already: the first rule of the cascade that rejects the text, or null.

    A null text has no words and is judged as an empty one. Repeated rows come out repeated.
    """
    cascade = [rule for rule, _, _ in ordered(docs, rules, sample_rows)]
    return docs.withColumn(name, _of(F.col("text"), lambda count: verdict(cascade, count)))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns; null texts count as empty, and repeated rows stay or go together."""
    cascade = [rule for rule, _, _ in ordered(docs, rules, sample_rows)]
    return docs.where(_of(F.col("text"), lambda count: verdict(cascade, count)).isNull())


def counts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) of each row.

    The five counts are wanted of every text. What the cascade needs beside them is computed only where a rule that asks
    for it is reached. A null text has no words and fails; an empty table gives no row. Repeated rows come out repeated,
    and columns other than doc_id and text are left out.
    """
    cascade = [rule for rule, _, _ in ordered(docs, rules, sample_rows)]
    given = lambda count: F.struct(*(count(name).alias(name) for name in GIVEN))
    both = lambda count: _let(given(count), lambda g: F.struct(
        *(g[name].alias(name) for name in GIVEN), verdict(cascade, lambda name: g[name] if name in GIVEN else count(name)).alias("rejected_by")
    ))
    each = docs.select("doc_id", _of(F.col("text"), both).alias("_counts")).select("doc_id", "_counts.*")
    fails = [rule.rejects(F.col) for rule in BASE]
    return each.select("doc_id", *GIVEN, (fails[0] | fails[1]).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")
