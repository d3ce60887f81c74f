import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from meterloom.functions import stats as st
from meterloom.operators import labels, ml, pu


def plain_shapley(tree, x, features):
    """Shapley values by all subsets of features."""
    def worth(known, i=0):
        value, weight, feature, threshold, left, right = tree[i]
        if feature is None:
            return value
        if feature in known:
            return worth(known, left if x[feature] <= threshold else right)
        return sum(tree[c][1] / weight * worth(known, c) for c in (left, right))

    phi = {}
    for f in features:
        others = [g for g in features if g != f]
        phi[f] = sum(math.factorial(k) * math.factorial(len(others) - k) / math.factorial(len(features)) * (worth({*s, f}) - worth(set(s))) for k in range(len(others) + 1) for s in itertools.combinations(others, k))
    return worth(set()), phi


def some_tree(rng, depth=4):
    tree = {}

    def grow(depth, weight):
        i = len(tree)
        tree[i] = None
        if depth == 0 or rng.random() < 0.2:
            tree[i] = (rng.random(), weight, None, None, -1, -1)
            return i
        share = rng.uniform(0.1, 0.9)
        f, t = rng.randrange(4), rng.random()
        left, right = grow(depth - 1, weight * share), grow(depth - 1, weight * (1 - share))
        tree[i] = (0.5, weight, f, t, left, right)
        return i

    grow(depth, 100.0)
    return tree


def test_shapley_values_against_all_subsets():
    rng = random.Random(3)
    for _ in range(60):
        tree, x = some_tree(rng), [rng.random() for _ in range(4)]
        mean, phi = ml.shapley(tree, x)
        want_mean, want = plain_shapley(tree, x, range(4))
        assert abs(mean - want_mean) < 1e-9 and all(abs(phi.get(f, 0.0) - v) < 1e-9 for f, v in want.items())


def test_numbers_of_groups(spark):
    rows = spark.range(3000).select(F.col("id").alias("mp_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("label"))
    got = st.numbered(rows, ["label"], "mp_id", 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.label, []).append(r)
    assert len(got) == 3000 and set(by) == {None, 0, 1, 2}
    for own in by.values():
        assert sorted(r.number for r in own) == list(range(len(own))) and {r.of for r in own} == {len(own)}
    again = {r.mp_id: r.number for r in st.numbered(rows.repartition(7), ["label"], "mp_id", 5).collect()}
    assert again == {r.mp_id: r.number for r in got} != {r.mp_id: r.number for r in st.numbered(rows, ["label"], "mp_id", 6).collect()}
    assert st.numbered(rows.limit(0), [], "mp_id").count() == 0


def test_auc_of_groups_against_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(12) / 4, rng.randrange(2)) for g in "abc" for _ in range(150)] + [("one", 1.0, 1), ("one", 2.0, 1), ("gap", None, 1)]
    got = {r.g: r.auc for r in st.auc(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in "abc":
        good, bad = [[s for h, s, y in rows if h == g and y == k] for k in (1, 0)]
        want = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
        assert abs(got[g] - want) < 1e-12
    assert got["one"] is None


def test_stratified_split_is_exact(spark):
    rows = spark.range(1001).select(F.col("id").alias("mp_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = {(r.label, r.test): r.n for r in labels.split(rows).groupBy("label", "test").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 81}


@pytest.fixture(scope="module")
def houses(spark):
    y = (F.col("id") % 4 == 0).cast("int")
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    return spark.range(240).select(F.col("id").alias("mp_id"), y.alias("label"), (noise(1) + y).alias("a"), noise(2).alias("b"))


def test_bagging_draws_as_many_as_there_are_positives(spark, houses, monkeypatch):
    sizes, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda rows, *a, **k: sizes.append({r.label: r["count"] for r in rows.groupBy("label").count().collect()}) or fit(rows, *a, **k))
    known, held = houses.where("label = 1 AND mp_id % 8 = 0"), houses.where("label = 1 AND mp_id % 8 <> 0")
    got = pu.bagging(known, houses.where("label = 0"), ["a", "b"], rounds=3, trees=5, held_out=held)
    rows = got.collect()
    assert sizes == [{1: 30, 0: 30}] * 3
    assert {r.mp_id for r in rows if not r.held_out} == set(range(240)) - {i for i in range(240) if i % 4 == 0}
    assert {r.mp_id for r in rows if r.held_out} == {i for i in range(240) if i % 8 == 4}
    s = pu.summary(got, 0.2).first()
    assert s.recall > 0.9 and s.positive_share < 0.1 and s.prior == 0.2


def test_bagging_with_fewer_unlabelled_than_positives(spark, houses):
    got = pu.bagging(houses.where("label = 0"), houses.where("label = 1"), ["a", "b"], rounds=2, trees=3).collect()
    assert len(got) == 60 and all(r.score is None for r in got)  # all are drawn in every round


def test_monte_carlo_scores_all(spark, houses):
    u = houses.where("label = 0").withColumn("w", F.lit(0.2))
    got = pu.monte_carlo(houses.where("label = 1"), u, ["a", "b"], rounds=2, trees=5).collect()
    assert got[0].asDict().keys() == {"mp_id", "score"} and len(got) == 180 and all(0 <= r.score <= 1 for r in got)


def test_full_forest(spark, houses):
    """The settings of a real run: 200 trees, 5 folds."""
    model = ml.fit(houses, ["a", "b"])
    assert model.getNumTrees == 200
    for r in houses.limit(2).collect():
        base, parts = ml.contributions(model, r.asDict(), ["a", "b"])
        assert base + sum(parts.values()) == pytest.approx(ml.score(model, houses.where(F.col("mp_id") == r.mp_id), ["a", "b"]).first().score, abs=1e-9)
    mean, deviation = ml.cross_validate(houses, ["a", "b"], trees=20)
    assert mean > 0.95 and 0 <= deviation < 0.1
