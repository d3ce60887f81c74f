import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.functions import profiles as p
from meterloom.functions import stats as st
from meterloom.session import tune


@pytest.fixture(scope="module")
def days(spark):
    tune(spark)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        v = np.where(rng.random(96) < 0.4, 0.0, rng.integers(0, 900, 96) / 256)
        kw = [None if rng.random() < 0.1 * (i % 3) else float(x) for x in v]
        rows.append((i, kw))
    rows += [(100, [None] * 96), (101, [0.0] * 96), (102, [3.0] * 96), (103, [1.0] + [0.0] * 94 + [1.0]), (104, [0.0] * 10 + [2.0] * 5 + [0.0] * 5 + [2.0] * 5 + [0.0] * 71)]
    # Behind a shuffle: the optimizer would otherwise evaluate the expressions on the local rows itself.
    return spark.createDataFrame(rows, "i int, kw array<double>").repartition(2), dict(rows)


def got(df, c):
    return {r.i: r.x for r in df.select("i", c.alias("x")).collect()}


def known(v):
    return np.array([x for x in v if x is not None])


def test_window_sums_and_counts(days):
    df, rows = days
    for a, b in ((0, 24), (11, 15), (22, 6), (20, 6)):
        s, n = got(df, p.window_sum(F.col("kw"), a, b)), got(df, p.window_count(F.col("kw"), a, b))
        for i, v in rows.items():
            own = known([v[k] for k in range(96) if ((a <= (k + 0.5) / 4 < b) if a < b else ((k + 0.5) / 4 >= a or (k + 0.5) / 4 < b))])
            assert s[i] == own.sum() and n[i] == len(own)


def test_quantiles(days):
    df, rows = days
    for q in (0.1, 0.5, 0.95, 0.99):
        x = got(df, p.quantile(F.col("kw"), q))
        for i, v in rows.items():
            own = known(v)
            assert x[i] == pytest.approx(np.quantile(own, q)) if len(own) else x[i] is None


def runs(active):
    out, begin = [], None
    for k, a in enumerate([*active, False]):
        if a and begin is None:
            begin = k
        elif not a and begin is not None:
            out.append((begin, k - begin))
            begin = None
    return out


def test_runs(days):
    df, rows = days
    df = p.sealed(df.select("i", p.bits(F.col("kw"), lambda v, k: v > 1.5).alias("b")))
    b = F.col("b")
    start, n = p.longest_run(b)
    found = {r.i: r for r in df.select("i", p.rising_edges(b).alias("e"), p.run_count(b, 2).alias("c"), start.alias("s"), n.alias("n"), p.ones(b).alias("o"), p.run_list(b).alias("l")).collect()}
    for i, v in rows.items():
        want = runs([x is not None and x > 1.5 for x in v])
        r = found[i]
        assert (r.e, r.c, r.o) == (len(want), sum(m >= 2 for _, m in want), sum(m for _, m in want))
        best = max(want, key=lambda x: (x[1], -x[0]), default=(None, 0))
        assert (r.s, r.n) == best
        assert [tuple(x) for x in r.l] == want


def test_min_hour_and_weighted(days):
    df, rows = days
    hours = p.sealed(df.select("i", p.hourly_means(F.col("kw")).alias("hours")))
    h, w = got(hours, p.min_hour(F.col("hours"))), got(df, p.weighted(F.col("kw"), 2))
    for i, v in rows.items():
        means = [known(v[4 * j : 4 * j + 4]).mean() if len(known(v[4 * j : 4 * j + 4])) else None for j in range(24)]
        have = known(means)
        if not len(have):
            assert h[i] == 0.5
            continue
        lo, tol = have.min(), max(0.02, 0.05 * have.mean())
        low = [m is not None and m <= lo + tol for m in means]
        want = means.index(lo) + 0.5 if low[0] and low[23] else sum(j for j in range(24) if low[j]) / max(1, sum(low)) + 0.5
        assert h[i] == pytest.approx(want)
        assert w[i] == pytest.approx(sum((x or 0) * ((k + 0.5) / 4) ** 2 for k, x in enumerate(v)))


def test_guarded_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 3.0), ("b", 1.0, 5.0), ("c", None, 1.0)], "g string, x double, y double")
    r = {x.g: x for x in df.groupBy("g").agg(st.pearson(F.col("x"), F.col("y")).alias("r"), st.slope(F.col("x"), F.col("y")).alias("b")).collect()}
    assert r["a"].r == pytest.approx(1) and r["a"].b == pytest.approx(2) and r["b"].r is None and r["b"].b is None and r["c"].r is None
    ranks = {x.value: x.pct for x in st.percentile_ranks(df, "y", buckets=3).collect()}
    assert ranks == pytest.approx({1.0: 0.2, 2.0: 0.4, 3.0: 0.6, 4.0: 0.8, 5.0: 1.0})
    assert st.percentile_ranks(df.limit(0), "y").count() == 0
