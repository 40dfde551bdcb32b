"""Tail probabilities and exact quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.functions.geo import EARTH_AREA_KM2
from fluxgrid.session import input_bytes

#: Above this size of its inputs a quantile is narrowed down before it is taken exactly.
NARROW_BYTES = 16 << 20


#: Values within a bracket that are sorted at once; a bracket with more is narrowed again.
SORTED_VALUES = 1 << 20
#: Half of a first bracket's width, as a share of all values, and the counters of a sketch.
STEP, SKETCH = 2e-4, 20_000


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], narrow: bool | None = None, sorted_values: int = SORTED_VALUES, step: float = STEP) -> DataFrame:
    """One row with exact quantiles of columns, {name: (column, p)}, linear between the two values next to each; nulls are skipped.

    An exact percentile keeps each distinct value. On large inputs all wanted order statistics are bracketed by one pass
    that makes a mergeable sketch of each column, and the values below and within all brackets are counted by another
    one. A bracket holds a few ten-thousandths of the values; what is still too many to sort is bracketed again within
    itself. Values that are left, and nothing else, are then sorted, each bracket by itself.
    """
    if narrow is None:
        narrow = input_bytes(df) > NARROW_BYTES
    if not narrow:
        return df.agg(*(F.percentile(c, p).alias(name) for name, (c, p) in wanted.items()))
    columns = {f"_{k}": F.col(c) if isinstance(c, str) else c for k, (c, _) in enumerate(wanted.values())}
    ps = dict(zip(columns, (p for _, p in wanted.values()), strict=True))
    rows = df.select(*(c.cast("double").alias(name) for name, c in columns.items()))

    inside = lambda c: F.col(c).between(*spans[c])

    def sketched(shares: dict[str, float]) -> dict[str, tuple[float, float]]:
        """The values on both sides of a share of those within each column's span, all in one pass."""
        near = [F.percentile_approx(F.when(inside(c), F.col(c)), [max(0.0, p - step), min(1.0, p + step)], SKETCH).alias(c) for c, p in shares.items()]
        return {c: tuple(x) for c, x in rows.agg(*near).first().asDict().items()}

    size = rows.agg(*(F.count(c).alias(c) for c in columns)).first().asDict()
    ranks = {c: (size[c] - 1) * ps[c] for c in columns if size[c]}
    spans = dict.fromkeys(ranks, (-math.inf, math.inf))
    spans |= sketched({c: ps[c] for c in ranks}) if ranks else {}
    found: dict[str, float | None] = dict.fromkeys(columns)
    todo, off, places = set(ranks), set(), {}
    while todo:
        told = rows.agg(*(x for c in sorted(todo) for x in (F.count_if(F.col(c) < spans[c][0]).alias(f"{c}b"), F.count_if(inside(c)).alias(f"{c}n")))).first()
        finer = {}
        for c in sorted(todo):
            place, n = math.floor(ranks[c]) - told[f"{c}b"], told[f"{c}n"]
            if place < 0 or place + (ranks[c] > math.floor(ranks[c])) >= n:  # the sketch was off
                spans[c] = (-math.inf, math.inf)
                off.add(c)
                continue
            todo.discard(c)
            if spans[c][0] == spans[c][1]:
                found[c] = spans[c][0]
                continue
            places[c] = place
            if n > sorted_values and c not in off:
                finer[c] = (place + 0.5) / n
        for c, span in (sketched(finer) if finer else {}).items():
            if span != spans[c]:
                spans[c] = span
                todo.add(c)
                places.pop(c)
    if places:
        each = F.explode(F.array_compact(F.array(*(F.when(inside(c), F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))) for c in places))))
        values = rows.select(each.alias("x")).select("x.c", "x.v")
        order = F.row_number().over(Window.partitionBy("c").orderBy("v"))
        at = F.element_at(F.create_map(*(F.lit(x) for c, place in places.items() for x in (c, place))), F.col("c"))
        pairs: dict[str, list[float]] = {}
        for r in values.withColumn("n", order - 1 - at).where(F.col("n").between(0, 1)).orderBy("c", "n").collect():
            pairs.setdefault(r.c, []).append(r.v)
        for c, pair in pairs.items():
            found[c] = pair[0] + (pair[-1] - pair[0]) * (ranks[c] - math.floor(ranks[c]))
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"`{name}` double" for name in wanted))


def quantile(df: DataFrame, value: str, p: float, name: str, narrow: bool | None = None) -> DataFrame:
    """One row with one of quantiles()."""
    return quantiles(df, {name: (value, p)}, narrow)


def null_recall(radius_km: Column, lookback: Column, lookahead: Column, total_days: Column, n_predicted: Column) -> Column:
    """The probability that one of n uniform predictions covers an incident."""
    space = F.lit(math.pi) * radius_km * radius_km / F.lit(EARTH_AREA_KM2)
    time = F.least(F.lit(1.0), (lookback + lookahead) / total_days)
    return F.lit(1.0) - F.pow(F.lit(1.0) - space * time, n_predicted)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P[X >= k] of a binomial variable; p is capped at 0.999999."""
    p = min(p, 0.999999)
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if k <= n * p:  # the complement is the shorter tail
        return max(0.0, 1.0 - _sum_from(n - k + 1, n, 1 - p))
    return min(1.0, _sum_from(k, n, p))


def _sum_from(k: int, n: int, p: float) -> float:
    """The terms from k on, which fall from there; those that no longer count are left out."""
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i = 0.0, 1.0, k
    while i <= n and term > total * 1e-18:
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
    return math.exp(log) * total
