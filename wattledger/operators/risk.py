"""Theft risk: positive-unlabelled classifiers, outlier consensus, calibration, reasons.

One model is trained over all feeders (the reference practice of one model per
feeder starves small feeders); ranks stay within each feeder.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import rnd
from wattledger.operators.features import FEATURES
from wattledger.scale import distribution, quantiles
from wattledger.session import materialize

PU_METHODS = ("elkan_noto", "bagging_pu", "spies")


def assemble(features: DataFrame, names=FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="x").transform(features)


def hash_unit(seed: int) -> Column:
    """Uniform [0,1) per meter, stable under repartitioning and recomputation."""
    return F.shiftrightunsigned(F.xxhash64("customer_unit_id", F.lit(seed)), 11) / float(1 << 53)


def _booster(seed: int, rounds: int) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="x", labelCol="s", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed, subsamplingRate=1.0
    )


def _score(model, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1])


def elkan_noto(rows: DataFrame, seed: int = 0, rounds: int = 20) -> DataFrame:
    """g(x)/c with c the mean score of held-out labelled positives."""
    train = rows.where(hash_unit(seed) < 0.7)
    scored = _score(_booster(seed, rounds).fit(train), rows, "g")
    held = F.avg(F.when((F.col("s") == 1) & (hash_unit(seed) >= 0.7), F.col("g")))
    any_pos = F.avg(F.when(F.col("s") == 1, F.col("g")))
    c = scored.agg(F.greatest(F.coalesce(held, any_pos, F.lit(1.0)), F.lit(1e-3)).alias("c")).scalar()
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("g") / c))
    return scored.select("customer_unit_id", unit.alias("score_pu"))


def bagging_pu(rows: DataFrame, seed: int = 0, n_estimators: int = 15, rounds: int = 5) -> DataFrame:
    """Positives against equal samples of the unlabelled; out-of-bag scores averaged.

    Fits are independent Spark jobs and run a few at a time.
    """
    size = rows.agg(F.sum("s").alias("p"), F.count(F.lit(1)).alias("n")).first()
    share = min(1.0, size["p"] / max(1, size["n"] - size["p"]))

    def member(b: int) -> DataFrame:
        drawn = hash_unit(seed * 1000 + b + 1) < share
        bag = rows.where((F.col("s") == 1) | drawn)
        model = _booster(seed + b, rounds).fit(bag)
        return _score(model, rows.where((F.col("s") == 1) | ~drawn), "g").select("customer_unit_id", "g")

    with ThreadPool(4) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(member), range(n_estimators))
    votes = parts[0]
    for part in parts[1:]:
        votes = votes.unionByName(part)
    mean = votes.groupBy("customer_unit_id").agg(F.avg("g").alias("score_pu"))
    return rows.select("customer_unit_id").join(mean, "customer_unit_id", "left").na.fill(0.0)


def spies(rows: DataFrame, seed: int = 0, spy_fraction: float = 0.15, rounds: int = 20) -> DataFrame:
    """Hidden positives set the threshold for reliable negatives, then a second fit."""
    spy = (F.col("s") == 1) & (hash_unit(seed) < spy_fraction)
    mixed = rows.withColumn("spy", spy).withColumn("truth", F.col("s"))
    mixed = mixed.withColumn("s", F.when(F.col("spy"), 0).otherwise(F.col("s")))
    first = _score(_booster(seed, rounds).fit(mixed), mixed, "p")
    first = materialize(first.select("customer_unit_id", "x", "truth", "spy", "p"), "spies")
    bar = quantiles(first.where("spy"), [], "p", {"thr": 0.1}).select("thr").scalar()
    chosen = first.where((F.col("truth") == 1) | (F.col("p") < F.coalesce(bar, F.lit(1.0))))
    train = chosen.select("customer_unit_id", "x", F.col("truth").alias("s"))
    return _score(_booster(seed + 1, rounds).fit(train), rows, "score_pu").select("customer_unit_id", "score_pu")


def fit_pu(rows: DataFrame, method: str = "elkan_noto", seed: int = 0) -> DataFrame:
    """``rows``: customer_unit_id, x (vector), s (1 = labelled positive)."""
    methods = {"elkan_noto": elkan_noto, "bagging_pu": bagging_pu, "spies": spies}
    if method not in methods:
        raise ValueError(f"unknown method {method}; choose one of {PU_METHODS}")
    return methods[method](rows, seed)


def ipw_weights(rows: DataFrame, clip: float = 10.0) -> DataFrame:
    """Inverse inspection propensity, mean one; ones when nobody or everybody was inspected.

    ``rows``: customer_unit_id, x, s (1 = inspected).
    """
    seen = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    if seen["lo"] == seen["hi"]:
        return rows.select("customer_unit_id", F.lit(1.0).alias("weight"))
    model = LogisticRegression(featuresCol="x", labelCol="s", maxIter=50, regParam=0.01).fit(rows)
    weight = F.lit(1.0) / F.greatest(F.lit(1.0 / clip), F.least(F.lit(1.0), F.col("p")))
    # a logistic score is one dot product with a few fitted numbers, so the plan holds no model
    fitted = F.array(*[F.lit(float(c)) for c in model.coefficients])
    terms = F.zip_with(vector_to_array("x"), fitted, lambda v, c: v * c)
    score = F.aggregate(terms, F.lit(float(model.intercept)), lambda acc, t: acc + t)
    scored = rows.select("customer_unit_id", (1 / (1 + F.exp(-score))).alias("p"))
    # written once: neither the mean nor the result scores the rows again
    raw = materialize(scored.select("customer_unit_id", weight.alias("w")), "propensities")
    mean = raw.agg(F.avg("w")).scalar()
    return raw.select("customer_unit_id", (F.col("w") / mean).alias("weight"))


def rank_norm(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Rank within the feeder scaled to [0,1]; equal values share a rank.

    Ranks are computed on distinct values, so neither a hot feeder nor a hot value
    is sorted in one task.
    """
    ranks = distribution(rows.select("feeder_id", value), ["feeder_id"], value).select(
        "feeder_id", value, (F.col("below") / F.greatest(F.col("n") - 1, F.lit(1))).alias(out)
    )
    return rows.join(ranks, ["feeder_id", value], "left")


def ecod(features: DataFrame, names=FEATURES) -> DataFrame:
    """Outlier score from empirical tail probabilities of every feature.

    Tails come from distinct values per (feeder, feature); the larger of the left,
    right and skew-chosen sums is the score.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), rnd(n, 9).alias("v")) for n in names])).alias("c")
    long = materialize(features.select("feeder_id", "customer_unit_id", packed).select("feeder_id", "customer_unit_id", "c.*"), "ecod")
    keys = ["feeder_id", "f"]
    tails = distribution(long, keys, "v").select(
        *keys,
        "v",
        "c",
        (-F.ln(F.col("upto") / F.col("n"))).alias("left"),
        (-F.ln((F.col("n") - F.col("below")) / F.col("n"))).alias("right"),
    )
    tails = materialize(tails, "ecod-tails")
    mean = tails.groupBy(*keys).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mu"))
    d = F.col("v") - F.col("mu")
    skew = tails.join(mean, keys).groupBy(*keys).agg(
        (F.sum(d * d * d * F.col("c")) < 0).alias("left_skewed")
    )
    scored = long.join(tails.drop("c"), [*keys, "v"]).join(skew, keys)
    chosen = F.when(F.col("left_skewed"), F.col("left")).otherwise(F.col("right"))
    return scored.groupBy("feeder_id", "customer_unit_id").agg(
        rnd(F.greatest(F.sum("left"), F.sum("right"), F.sum(chosen)), 6).alias("ecod")
    )


def unsupervised(features: DataFrame) -> DataFrame:
    """Outlier rank within the feeder."""
    return rank_norm(ecod(features), "ecod", "score_unsup").select("feeder_id", "customer_unit_id", "score_unsup")


def ensemble(pu: DataFrame, unsup: DataFrame) -> DataFrame:
    """0.6 x rank of the classifier + 0.4 x outlier rank."""
    rows = unsup.join(pu, "customer_unit_id")
    ranked = rank_norm(rows, "score_pu", "rank_pu")
    return ranked.select(
        "feeder_id",
        "customer_unit_id",
        "score_pu",
        "score_unsup",
        (F.col("rank_pu") * 0.6 + F.col("score_unsup") * 0.4).alias("ensemble"),
    )


#: score bins of the calibration: all that reaches the driver is a sum and a count for each
CALIBRATION_BINS = 1000


def isotonic(sums: list[float], counts: list[int]) -> list[float]:
    """Nearest non-decreasing shares of weighted bins (pool adjacent violators); None for leading empty bins."""
    blocks: list[list] = []
    for i, (total, n) in enumerate(zip(sums, counts)):
        if n:
            blocks.append([total, n, i])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
                total, n, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, last]
    out, at = [], 0
    for i in range(len(sums)):
        while at + 1 < len(blocks) and i > blocks[at][2]:
            at += 1
        out.append(blocks[at][0] / blocks[at][1] if blocks else 0.0)
    return out


def calibrate(scored: DataFrame) -> DataFrame:
    """Isotonic probability from ``ensemble`` (0 to 1) against ``s``, fitted on bins of the score."""
    place = F.least(F.floor(rnd("ensemble", 6) * CALIBRATION_BINS), F.lit(CALIBRATION_BINS)).cast("int")
    rows = scored.withColumn("_bin", place)
    found = {r["_bin"]: r for r in rows.groupBy("_bin").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    bins = range(CALIBRATION_BINS + 1)
    fitted = isotonic([found[i]["s"] if i in found else 0 for i in bins], [found[i]["n"] if i in found else 0 for i in bins])
    return rows.withColumn("calibrated", F.get(F.array(*map(F.lit, fitted)), F.col("_bin"))).drop("_bin")


def explain_top3(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Three signed reasons for every meter.

    A reason is a feature's importance times its z-score over all meters.
    """
    weights = weights or {n: 1.0 for n in FEATURES}
    moments = [f"{fn}({n}) as {tag}_{n}" for n in FEATURES for fn, tag in (("avg", "m"), ("stddev_pop", "s"))]
    stats = features.selectExpr(*moments).select(F.struct("*").alias("st")).scalar()
    reasons = []
    for n in FEATURES:
        z = f"if(st.s_{n} > 1e-12, ({n} - st.m_{n}) / st.s_{n}, 0D) * {weights[n]!r}D"
        reasons.append(f"struct(-round(abs({z}), 6) as o, '{n}' as n, if({z} > 0, '+', '-') as d)")
    best = F.expr(f"slice(array_sort(array({', '.join(reasons)})), 1, 3)")
    text = F.transform(best, lambda r: F.format_string("%s (%s)", r["n"], r["d"]))
    rows = features.withColumn("st", stats).withColumn("t", text)
    return rows.select("customer_unit_id", *[F.get("t", F.lit(i)).alias(f"reason_{i + 1}") for i in range(3)])


def positives(theft_labels: DataFrame, mined: DataFrame | None) -> DataFrame:
    """Confirmed thefts; without any, meters with a high-confidence mined label."""
    found = theft_labels.where("is_theft").select("customer_unit_id").distinct()
    if mined is None or found.head(1):
        return found
    return mined.where(F.col("label_source").isin("M1_drop_recovery", "M2_jump_after_intervention")).select(
        "customer_unit_id"
    ).distinct()


def train_risk(
    features: DataFrame, positive: DataFrame, cfg: dict, method: str = "elkan_noto", seed: int = 0
) -> DataFrame:
    """Calibrated risk per meter with its reasons.

    ``features`` must be a written table.  Without positives only outliers rank.
    """
    labelled = positive.select("customer_unit_id", F.lit(1).alias("s"))
    rows = features.join(labelled, "customer_unit_id", "left").na.fill(0, ["s"])
    rows = materialize(assemble(rows).select("customer_unit_id", "x", "s"), "pu-rows")
    unsup = materialize(unsupervised(features), "unsup")
    energy = features.select("customer_unit_id", F.col("mean_6").alias("recoverable_kwh_month"))
    if not rows.where("s = 1").head(1):
        alone = unsup.select(
            "feeder_id", "customer_unit_id", rnd("score_unsup", 5).alias("risk_score"),
            F.lit(0.0).alias("score_pu"), rnd("score_unsup", 5).alias("score_unsup"),
        )
        scored = alone
    else:
        pu = materialize(fit_pu(rows, method, seed), "pu")
        mixed = ensemble(pu, unsup).join(rows.select("customer_unit_id", "s"), "customer_unit_id")
        scored = calibrate(materialize(mixed, "ensemble")).select(
            "feeder_id",
            "customer_unit_id",
            rnd("calibrated", 5).alias("risk_score"),
            rnd("score_pu", 5).alias("score_pu"),
            rnd("score_unsup", 5).alias("score_unsup"),
        )
    scored = materialize(scored, "risk-scores")
    importance = _importance(rows, seed) if rows.where("s = 1").head(1) else None
    reasons = explain_top3(features, importance)
    return (
        scored.join(reasons, "customer_unit_id", "left")
        .na.fill("", ["reason_1", "reason_2", "reason_3"])
        .join(energy, "customer_unit_id")
    )


def _importance(rows: DataFrame, seed: int) -> dict[str, float]:
    model = _booster(seed, 10).fit(rows)
    return {n: float(model.featureImportances[i]) for i, n in enumerate(FEATURES)}
