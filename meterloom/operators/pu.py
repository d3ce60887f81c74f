"""Learning from positive and unlabelled houses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions import stats as st
from meterloom.operators import ml
from meterloom.session import checkpointed, shared_path

#: Share of houses with the asset (fixed value: installations over buildings).
PRIOR = 338270 / 1800000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of its parts: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def guide_feature(labelled: DataFrame, features: list[str], label: str = "label") -> tuple[str, int, float]:
    """The feature whose univariate AUC is farthest from 1/2 (the first on ties), its sign and its AUC."""
    long = labelled.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("x")).select("y", "x.*").where("v IS NOT NULL")
    best = st.auc(long, ["i"], "v", "y").orderBy(F.abs(F.col("auc") - 0.5).desc(), "i").first()
    return features[best.i], 1 if best.auc >= 0.5 else -1, best.auc


def spearman(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation with averaged ties: rho and n."""
    r = rows.join(st.percentile_ranks(rows, x).withColumnsRenamed({"value": x, "pct": "a"}), x).join(st.percentile_ranks(rows, y).withColumnsRenamed({"value": y, "pct": "b"}), y)
    return r.agg(st.pearson(F.col("a") * 1000, F.col("b") * 1000).alias("rho"), F.count(F.lit(1)).alias("n"))


def is_monotone(rows: DataFrame, x: str, y: str, least_p: float = 0.05) -> bool:
    """Whether rho is positive and significant (normal approximation of its t statistic)."""
    from statistics import NormalDist

    r = spearman(rows, x, y).first()
    if r.rho is None or r.n < 4 or r.rho <= 0:
        return False
    t = r.rho * ((r.n - 2) / max(1e-12, 1 - r.rho**2)) ** 0.5
    return 2 * (1 - NormalDist().cdf(t)) < least_p


def sampling_weights(rows: DataFrame, guide: str, prior: float, spread: float) -> DataFrame:
    """rows with w: the prior, tilted by the guide's percentile rank and clipped to [0, 1]."""
    r = st.percentile_ranks(rows, guide).withColumnRenamed("value", guide)
    return rows.join(r, guide).withColumn("w", F.least(F.greatest(prior + spread * (F.col("pct") - 0.5), F.lit(0.0)), F.lit(1.0))).drop("pct")


def _rounds(positive: DataFrame, unlabelled: DataFrame, held_out: DataFrame | None, features: list[str], rounds: int, trees: int, seed: int, negatives, weight: str | None = None) -> DataFrame:
    """Mean score of the unlabelled (and held-out) houses over rounds of fitting positives against what `negatives` labels.

    negatives(unlabelled, round) adds label (null: not in this round's fit) and counted (whether the round's
    score counts). Inputs are computed once; every round writes its scores to the shared folder, so the plan
    doesn't grow with the rounds and a lost executor costs one round's work.
    """
    spark = positive.sparkSession
    more = [weight] if weight else []
    positive = checkpointed(positive.select("mp_id", *features).withColumn("label", F.lit(1)))
    unlabelled = checkpointed(unlabelled.select("mp_id", *features, *more))
    other = checkpointed(held_out.select("mp_id", *features)) if held_out is not None else None
    at = shared_path(spark, "rounds")
    for r in range(rounds):
        drawn = negatives(unlabelled, r)
        data = positive.unionByName(drawn.where("label IS NOT NULL").select("mp_id", *features, F.col("label").cast("int").alias("label")))
        model = ml.fit(data, features, trees=trees, seed=seed + r)
        scored = ml.score(model, drawn, features).select("mp_id", F.lit(False).alias("held_out"), F.when(F.col("counted"), F.col("score")).alias("score"))
        if other is not None:
            scored = scored.unionByName(ml.score(model, other, features).select("mp_id", F.lit(True).alias("held_out"), "score"))
        scored.write.mode("append").parquet(at)
    out = spark.read.parquet(at).groupBy("held_out", "mp_id").agg(F.avg("score").alias("score"))
    return out.select("mp_id", "held_out", "score") if held_out is not None else out.select("mp_id", "score")


def monte_carlo(positive: DataFrame, unlabelled: DataFrame, features: list[str], weight: str = "w", rounds: int = 100, trees: int = 200, seed: int = 1, held_out: DataFrame | None = None) -> DataFrame:
    """Mean score of the unlabelled over rounds in which they are labelled at random by their weight.

    With `held_out` houses (positives that teach nothing) these are scored in every round too and told apart by a
    column held_out.
    """
    draw = lambda u, r: u.withColumns({"label": (uniform(F.col("mp_id"), F.lit(seed), F.lit(r)) < F.col(weight)).cast("int"), "counted": F.lit(True)})
    return _rounds(positive, unlabelled, held_out, features, rounds, trees, seed, draw, weight)


def bagging(positive: DataFrame, unlabelled: DataFrame, features: list[str], rounds: int = 100, trees: int = 200, seed: int = 1, held_out: DataFrame | None = None) -> DataFrame:
    """Out-of-bag mean score: every round takes exactly as many unlabelled as there are positive (all, if there are fewer), without replacement, for negatives.

    A house that was drawn in every round has a null score. held_out as in monte_carlo.
    """
    n = positive.count()

    def draw(u, r):
        bag = st.numbered(u, [], "mp_id", seed, r)
        return bag.withColumns({"label": F.when(F.col("number") < n, F.lit(0)), "counted": F.col("number") >= n}).drop("number", "of")

    return _rounds(positive, unlabelled, held_out, features, rounds, trees, seed, draw)


def summary(scores: DataFrame, prior: float, threshold: float = 0.5) -> DataFrame:
    """recall over held-out positives and the share of the unlabelled above the threshold, beside the prior; scores: held_out, score."""
    hit = (F.col("score") > threshold).cast("double")
    return scores.agg(st.mean_if(F.col("held_out"), hit).alias("recall"), st.mean_if(~F.col("held_out"), hit).alias("positive_share"), F.lit(prior).alias("prior"))
