"""Queries of the model operators; forests have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom import fixtures as fx
from meterloom.functions import profiles as prof
from meterloom.operators import ml, pu
from meterloom.plans import hp30, pv
from meterloom.queries.base import query
from meterloom.session import shared_path
from meterloom.sources import store

FEATURES = [f"f{i}" for i in range(64)]


def matrix(spark, d):
    """FX6: the 64 numbers of each embedding with a binary label; f0 is shifted by the label."""
    v = fx.table(spark, d, "embeddings")
    y = (F.col("label") % 2).cast("int")
    feats = [(F.get("embedding", F.lit(i)).cast("double") + (y * 0.3 if i == 0 else 0.0)).alias(f"f{i}") for i in range(64)]
    return v.select(F.col("vec_id").alias("mp_id"), y.alias("label"), *feats)


@query("l5_forest_scores")
def l5(spark, d):
    rows = matrix(spark, d)
    return ml.score(ml.fit(rows, FEATURES, trees=20, depth=6), rows, FEATURES).select("mp_id", "score")


@query("l7_explanations")
def l7(spark, d):
    rows = matrix(spark, d)
    model = ml.fit(rows, FEATURES, trees=10, depth=5)
    first = rows.orderBy("mp_id").first().asDict()
    return spark.createDataFrame([(f, float(v)) for f, v in ml.explain(model, first, FEATURES)], "feature string, contribution double")


@query("l8_score_shares")
def l8(spark, d):
    return l5(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") > 0.5).cast("double")).alias("share"))


@query("l9_save_and_load")
def l9(spark, d):
    rows, at = matrix(spark, d), shared_path(spark, "model")
    ml.save(ml.fit(rows, FEATURES, trees=5, depth=4), FEATURES, at, spark)
    model, feats = ml.load(at, spark)
    return ml.score(model, rows, feats).select("mp_id", "score")


@query("l10_cross_validation")
def l10(spark, d):
    mean, std = ml.cross_validate(matrix(spark, d), FEATURES, folds=5, trees=10, depth=4)
    return spark.createDataFrame([(mean, std)], "auc double, deviation double")


@query("l11_train_test_gap")
def l11(spark, d):
    from meterloom.operators.labels import split

    rows = split(matrix(spark, d))
    model = ml.fit(rows.where(~F.col("test")), FEATURES, trees=10, depth=4)
    side = lambda t, n: ml.evaluate(ml.score(model, rows.where(t), FEATURES)).select(F.col("auc").alias(n))
    return side(~F.col("test"), "train_auc").crossJoin(side(F.col("test"), "test_auc"))


@query("l12_score_assets")
def l12(spark, d):
    rows = matrix(spark, d)
    models = {n: ml.fit(rows.withColumn("label", ((F.col("mp_id") + i) % 2).cast("int")), FEATURES, trees=5, depth=3) for i, n in enumerate(("pv", "battery"))}
    return ml.side_by_side({n: ml.score(m, rows, FEATURES).withColumnRenamed("score", n) for n, m in models.items()})


@query("l13_synthetic_data")
def l13(spark, d):
    normal = lambda i: F.sqrt(-2 * F.ln(1 - pu.uniform(F.col("mp_id"), F.lit(2 * i)))) * F.cos(6.283185307179586 * pu.uniform(F.col("mp_id"), F.lit(2 * i + 1)))
    return spark.range(500).select(F.col("id").alias("mp_id")).select("mp_id", normal(0).alias("a"), normal(1).alias("b"), (normal(0) > 0).cast("long").alias("label"))


@query("p16_fill_table", "SELECT p_partkey, CASE WHEN p_size > 25 THEN round(p_retailprice + 1e-9, 6) ELSE 1 END AS import_summer_to_winter_ratio, CAST(CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS BIGINT) AS n_filled_features FROM part")
def p16(spark, d):
    x = fx.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("import_summer_to_winter_ratio"))
    return pv.fill(x, pv.FILLS_25, ["import_summer_to_winter_ratio"])


@query("p19_column_order", "SELECT p_size AS size, p_partkey AS id FROM part".replace("p_size AS size", "CAST(p_size AS BIGINT) AS size"))
def p19(spark, d):
    x = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), "p_name")
    return ml.require(x, ["size", "id"]).select("size", "id")


@query("pu4_monte_carlo")
def pu4(spark, d):
    rows = matrix(spark, d)
    u = pu.sampling_weights(rows.where("label = 0"), "f0", 0.2, 0.2)
    return pu.monte_carlo(rows.where("label = 1"), u, FEATURES, rounds=2, trees=5)


@query("pu6_held_out_recall")
def pu6_held_out(spark, d):
    """Recall over positives that never teach and the positive share of the unlabelled, from real rounds."""
    rows = matrix(spark, d).withColumn("known", F.expr("label = 1 AND f1 > 0"))
    u = pu.sampling_weights(rows.where("label = 0"), "f0", 0.2, 0.2)
    scores = pu.monte_carlo(rows.where("known"), u, FEATURES, rounds=2, trees=5, held_out=rows.where("label = 1 AND NOT known"))
    return pu.summary(scores, 0.2)


@query("pu5_bagging")
def pu5(spark, d):
    """A third of the positives are known; the others are hidden among the unlabelled."""
    rows = matrix(spark, d).withColumn("known", F.expr("label = 1 AND mp_id % 3 = 0"))
    return pu.bagging(rows.where("known"), rows.where("NOT known"), FEATURES, rounds=3, trees=5)


@query("pu7_positive_unlabelled_flow")
def pu7(spark, d):
    """Guide feature, monotonicity, weights with the fixed prior, two short Monte-Carlo rounds."""
    rows = matrix(spark, d)
    guide, sign, _ = pu.guide_feature(rows, FEATURES)
    tilted = rows.withColumn("g", F.col(guide) * sign)
    spread = pu.PRIOR if pu.is_monotone(tilted, "g", "label") else 0.0
    u = pu.sampling_weights(tilted.where("label = 0"), "g", pu.PRIOR, spread)
    return pu.monte_carlo(rows.where("label = 1"), u, FEATURES, rounds=2, trees=5)


@query("x1_noon_days", "SELECT user_id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS noon_day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def x1(spark, d):
    e = fx.table(spark, d, "events")
    return e.groupBy("user_id", (F.col("ts") - F.expr("INTERVAL 12 HOURS")).cast("date").alias("noon_day")).agg(F.count(F.lit(1)).alias("n"))


@query("s13_store_whole_round_trip", f"WITH {fx.METER_SQL} SELECT mp_id, channel, round(sum(r) + 1e-9, 6) AS tot, CAST(count(r) AS BIGINT) AS slots, CAST(count(DISTINCT date) AS BIGINT) AS days FROM kwr GROUP BY ALL")
def s13_whole(spark, d):
    """Writes a store of all meter-days and reads all of it back."""
    at = shared_path(spark, "store-whole")
    store.write(fx.meter_days(spark, d), at, buckets=16)
    x = store.read(spark, at, n_buckets=16).select("mp_id", "channel", "date", prof.floored(F.col("kw")).alias("kw"))
    return x.groupBy("mp_id", "channel").agg(F.sum(prof.window_sum(F.col("kw"))).alias("tot"), F.sum(prof.window_count(F.col("kw"))).alias("slots"), F.countDistinct("date").alias("days"))
