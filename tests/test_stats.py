"""Exact quantiles of several columns at once, whatever the brackets do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.functions import stats


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=40_000), np.round(rng.exponential(size=40_000), 1)
    rows = [(float(x), None if k % 7 == 0 else float(y), 5.0, None) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6).persist()
    return a, np.array([y for k, y in enumerate(b) if k % 7]), df


@pytest.mark.parametrize(("most", "step"), [(1 << 20, 2e-4), (50, 2e-4), (50, 2e-3), (5, 0.0)])
def test_quantiles_equal_numpy(table, most, step):
    a, b, df = table
    wanted = {f"{c}{p}": (F.col(c) if c != "x" else F.abs("a"), p) for c in "abcdx" for p in (0.0, 0.01, 0.5, 0.99, 1.0)}
    got = stats.quantiles(df, wanted, narrow=True, sorted_values=most, step=step).first().asDict()
    assert list(got) == list(wanted)
    for c, values in (("a", a), ("b", b), ("c", np.array([5.0])), ("x", np.abs(a))):
        for p in (0.0, 0.01, 0.5, 0.99, 1.0):
            assert got[f"{c}{p}"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert got["d0.5"] is None
    plain = stats.quantiles(df, {"m": ("a", 0.5), "n": ("d", 0.5)}, narrow=False).first()
    assert plain.m == pytest.approx(np.median(a)) and plain.n is None


def test_one_quantile(table):
    a, _, df = table
    assert stats.quantile(df, "a", 0.975, "thr", narrow=True).first().thr == pytest.approx(np.quantile(a, 0.975))
    assert stats.quantile(df.limit(0), "a", 0.5, "m", narrow=True).first().m is None
