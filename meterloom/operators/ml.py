"""Random-forest models over feature tables: fit, evaluate, explain, score, save."""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import stats as st
from meterloom.session import checkpointed, shared_path


def require(table: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in the model's order; an error that names the missing ones."""
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return table


def _vectors(table: DataFrame, features: list[str]) -> DataFrame:
    filled = require(table, features).select("*", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__{f}") for f in features])
    return VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__x").transform(filled).drop(*[f"__{f}" for f in features])


def fit(rows: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 12, leaf: int = 3, seed: int = 42) -> RandomForestClassificationModel:
    """A forest with balanced class weights."""
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col(label) == c, F.lit(n / (len(counts) * k))) for c, k in counts.items()])
    data = _vectors(rows.withColumn("__w", weight), features)
    forest = RandomForestClassifier(labelCol=label, featuresCol="__x", weightCol="__w", numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, seed=seed)
    return forest.fit(data)


def score(model: RandomForestClassificationModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with score, the probability of class 1."""
    out = model.transform(_vectors(rows, features))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def evaluate(scored: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """precision, recall, auc (rank sums, ties averaged) and n."""
    y, hit = F.col(label) == 1, F.col("score") > threshold
    main = scored.agg(st.ratio(st.count_if(hit & y).cast("double"), st.count_if(hit)).alias("precision"), st.ratio(st.count_if(hit & y).cast("double"), st.count_if(y)).alias("recall"), F.count(F.lit(1)).alias("n"), st.count_if(y).alias("n1"))
    ranks = st.percentile_ranks(scored, "score").withColumnRenamed("value", "score")
    total = scored.join(ranks, "score").agg(F.sum(F.when(y, F.col("pct"))).alias("p"))
    auc = (F.col("p") * F.col("n") - F.col("n1") * (F.col("n1") + 1) / 2) / F.when((F.col("n1") > 0) & (F.col("n1") < F.col("n")), F.col("n1") * (F.col("n") - F.col("n1")))
    return main.crossJoin(total).select("precision", "recall", auc.alias("auc"), "n")


def importances(model: RandomForestClassificationModel, features: list[str], n: int = 10) -> list[tuple[str, float]]:
    """The n most important features."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def trees_of(model: RandomForestClassificationModel) -> list[dict]:
    """The fitted trees, each node number -> (probability of class 1, weight, feature, threshold, left, right).

    Read from the model's stored form in one pass; a leaf has no feature. A model's size bounds the result.
    """
    spark = SparkSession.active()
    at = shared_path(spark, "forest")
    model.write().overwrite().save(at)
    trees: list[dict] = [{} for _ in range(model.getNumTrees)]
    for r in spark.read.parquet(f"{at}/data").select("treeID", "nodeData.*").collect():
        total = sum(r.impurityStats)
        split = (r.split.featureIndex, r.split.leftCategoriesOrThreshold[0]) if r.leftChild >= 0 else (None, None)
        trees[r.treeID][r.id] = (r.impurityStats[1] / total if total else 0.0, total, *split, r.leftChild, r.rightChild)
    return trees


def shapley(tree: dict, x: list[float]) -> tuple[float, dict[int, float]]:
    """The tree's mean and the Shapley values of the features for one row: together its prediction.

    A set of features is worth the mean over all leaves that its values allow, weighted by the training rows
    where a feature outside the set decides. For one leaf with features F on its path, that worth is a
    product over F of o (1 if the row takes the path's branches, else 0) inside the set and z (the share of rows that take them)
    outside; the sums over all sets of one size are the coefficients of prod(z + o * y).
    """
    phi: dict[int, float] = {}
    mean = 0.0
    todo = [(0, {}, 1.0)]  # node, feature -> (z, o), share of rows
    while todo:
        i, path, share = todo.pop()
        value, weight, feature, threshold, left, right = tree[i]
        if feature is None:
            mean += share * value
            coefficients = [1.0]
            for z, o in path.values():
                coefficients = [z * (coefficients[k] if k < len(coefficients) else 0.0) + (o * coefficients[k - 1] if k else 0.0) for k in range(len(coefficients) + 1)]
            d = len(path)
            for f, (z, o) in path.items():
                rest = _without(coefficients, z, o)
                worth = sum(c * math.factorial(k) * math.factorial(d - 1 - k) for k, c in enumerate(rest)) / math.factorial(d)
                phi[f] = phi.get(f, 0.0) + value * (o - z) * worth
            continue
        taken = left if x[feature] <= threshold else right
        for child in (left, right):
            part = tree[child][1] / weight if weight else 0.5
            if part > 0:  # a branch without training rows has no share in any mean
                z, o = path.get(feature, (1.0, 1.0))
                todo.append((child, path | {feature: (z * part, o if child == taken else 0.0)}, share * part))
    return mean, phi


def _without(coefficients: list[float], z: float, o: float) -> list[float]:
    """The coefficients of the product without its factor z + o * y (z > 0; o is 0 or 1)."""
    if o == 0:
        return [c / z for c in coefficients[:-1]]
    out, carry = [], 0.0
    for c in reversed(coefficients[1:]):
        carry = c - z * carry
        out.append(carry)
    return out[::-1]


def contributions(model: RandomForestClassificationModel, row: dict, features: list[str]) -> tuple[float, dict[str, float]]:
    """The forest's mean and every feature's exact Shapley value for one house: they add up to its score."""
    x = [float(row.get(f) or 0.0) for f in features]
    base, total = 0.0, dict.fromkeys(features, 0.0)
    trees = trees_of(model)
    for tree in trees:
        mean, phi = shapley(tree, x)
        base += mean / len(trees)
        for f, v in phi.items():
            total[features[f]] += v / len(trees)
    return base, total


def explain(model: RandomForestClassificationModel, row: dict, features: list[str], n: int = 5) -> list[tuple[str, float]]:
    """The n largest signed contributions to one house's score (Shapley values over the trees)."""
    return sorted(contributions(model, row, features)[1].items(), key=lambda x: (-abs(x[1]), x[0]))[:n]


def cross_validate(rows: DataFrame, features: list[str], folds: int = 5, label: str = "label", seed: int = 42, **how) -> tuple[float, float]:
    """Mean and population standard deviation of the AUC over stratified folds."""
    dealt = checkpointed(st.numbered(rows.select("mp_id", label, *features), [label], "mp_id", seed).withColumn("__fold", F.col("number") % folds).drop("number", "of"))
    aucs = []
    for k in range(folds):
        model = fit(dealt.where(F.col("__fold") != k), features, label, seed=seed, **how)
        aucs.append(evaluate(score(model, dealt.where(F.col("__fold") == k), features), label).first().auc)
    mean = sum(aucs) / folds
    return mean, (sum((a - mean) ** 2 for a in aucs) / folds) ** 0.5


def side_by_side(scores: dict[str, DataFrame]) -> DataFrame:
    """Scores of several assets in one row a house; null where an asset has no score."""
    out = None
    for name, s in scores.items():
        s = s.select("mp_id", name)
        out = s if out is None else out.join(s, "mp_id", "full_outer")
    return out


def save(model: RandomForestClassificationModel, features: list[str], path: str, spark) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(features),)], "features string").write.mode("overwrite").json(f"{path}/features")


def load(path: str, spark) -> tuple[RandomForestClassificationModel, list[str]]:
    return RandomForestClassificationModel.load(f"{path}/model"), json.loads(spark.read.json(f"{path}/features").first().features)
