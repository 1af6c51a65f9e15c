"""Diagnostics on paired cells: reference matches, thresholds, reports and logistic scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.extensions import sigmoid_scores
from helixframe.plans.materialise import broadcast_if_small
from helixframe.plans.running import running, tiled


def reference_results(runs: DataFrame, matches: DataFrame, target: str, overlap: int, limit: float) -> DataFrame:
    """runs with p, overlap and weak of the best match to target of at least overlap; without one (1.0, 0, 1).

    The best has the least p, on ties the first place in its file."""
    fit = matches.where((F.col("target") == target) & (F.col("match_overlap") >= overlap))
    best = fit.groupBy("run_id").agg(F.min_by(F.struct("p", "match_overlap"), F.struct("p", "place")).alias("m"))
    found = runs.join(best, "run_id", "left")
    p = F.coalesce("m.p", F.lit(1.0))
    return found.withColumns({"p": p, "overlap": F.coalesce("m.match_overlap", F.lit(0)), "weak": (p > limit).cast("int")}).drop("m")


def thresholds(scored: DataFrame, by: list[str], limit: float) -> DataFrame:
    """by and threshold: the least score at which at most limit of the negatives (label 0) score as high; if there is none, the next number above the highest score."""
    counts = tiled(scored.groupBy(*by, "score").agg(F.sum(1 - F.col("label")).alias("n")), by, "score", descending=True)
    above = running(counts, by, "tile", [F.desc("score")], sums={"higher": F.col("n")})
    totals = broadcast_if_small(counts.groupBy(*by).agg(F.sum("n").alias("total")))
    judged = above.join(totals, by)
    fit = F.min(F.when((F.col("higher") + F.col("n")) <= limit * F.col("total"), F.col("score")))
    return judged.groupBy(*by).agg(F.coalesce(fit, next_after(F.max("score"))).alias("threshold"))


def next_after(x: Column) -> Column:
    """The next double above x, for normal numbers: x and one unit in its last place."""
    size = F.abs(x.cast("double"))
    power = F.floor(F.log2(size))
    power = power - F.when(F.pow(F.lit(2.0), power) > size, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), power + 1) <= size, 1).otherwise(0)
    # below a negative power of two the numbers are half as far apart
    power = power - F.when((x < 0) & (F.pow(F.lit(2.0), power) == size), 1).otherwise(0)
    return F.when(x == 0, F.lit(5e-324)).otherwise(x + F.pow(F.lit(2.0), power - 52))


def report(scored: DataFrame, threshold: float, level: str) -> DataFrame:
    """level (null for the whole) with counts and rates of alerts (score >= threshold) against label 1."""
    alert = F.col("score") >= threshold
    n = lambda c: F.sum(c.cast("bigint"))
    one, zero = F.col("label") == 1, F.col("label") == 0
    rate = lambda a, b: F.when(b > 0, a / b)
    return scored.groupingSets([[], [F.col(level)]], F.col(level)).agg(
        F.count("*").alias("n"), n(one).alias("positives"), n(alert & one).alias("true_alerts"), n(alert & zero).alias("false_alerts"),
        rate(n(alert & one), n(one)).alias("sensitivity"), rate(n(alert & zero), n(zero)).alias("false_positive_rate"), rate(n(alert & one), n(alert)).alias("alert_precision"),
    )


def report_by_scorer(scored: DataFrame, thresholds: dict[str, float], level: str) -> DataFrame:
    """scorer and level (null for the whole) with counts and rates of alerts, for scores in long form (scorer, level, score, label)."""
    limit = F.coalesce(*[F.when(F.col("scorer") == k, F.lit(float(v))) for k, v in thresholds.items()])
    alert = F.col("score") >= limit
    n = lambda c: F.sum(c.cast("bigint"))
    one, zero = F.col("label") == 1, F.col("label") == 0
    rate = lambda a, b: F.when(b > 0, a / b)
    return scored.groupingSets([[F.col("scorer")], [F.col("scorer"), F.col(level)]], F.col("scorer"), F.col(level)).agg(
        F.count("*").alias("n"), n(one).alias("positives"), n(alert & one).alias("true_alerts"), n(alert & zero).alias("false_alerts"),
        rate(n(alert & one), n(one)).alias("sensitivity"), rate(n(alert & zero), n(zero)).alias("false_positive_rate"), rate(n(alert & one), n(alert)).alias("alert_precision"),
    )


def fit_models(train: DataFrame, models: dict[str, list[str]], strength: float = 1.0) -> dict[str, dict]:
    """A frozen logistic model for each set of features: features, mean, scale, coefficients and intercept, plain numbers.

    Fitted on train (label) only, on standardised features, with a ridge penalty of
    1 / strength; a constant feature has scale 1. Fails on labels of one class, features that
    are not finite, and a fit that does not settle."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    every = list(dict.fromkeys(f for features in models.values() for f in features))
    fine = lambda c: F.max((F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("int"))
    stats = train.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"), F.greatest(*[fine(c) for c in every], F.lit(0)).alias("bad"), *[F.avg(c).alias(f"m_{c}") for c in every], *[F.stddev_pop(c).alias(f"s_{c}") for c in every]).first()
    if stats["classes"] != 2:
        raise ValueError("both classes are needed")
    if stats["bad"]:
        raise ValueError("features must be finite")
    out = {}
    for name, features in models.items():
        mean, scale = [stats[f"m_{c}"] for c in features], [stats[f"s_{c}"] or 1.0 for c in features]
        scaled = train.select("label", *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(features, mean, scale, strict=True)])
        rows = VectorAssembler(inputCols=features, outputCol="x_", handleInvalid="error").transform(scaled)
        fit = LogisticRegression(featuresCol="x_", labelCol="label", regParam=1 / (strength * stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-9).fit(rows)
        if fit.summary.totalIterations >= 2000:
            raise ValueError("the fit did not settle")
        out[name] = {"features": features, "mean": mean, "scale": scale, "coefficients": list(map(float, fit.coefficients)), "intercept": float(fit.intercept)}
    return out


def predictions(rows: DataFrame, frozen: dict[str, dict]) -> DataFrame:
    """rows with risk_NAME for each frozen model; means, scales and coefficients are those of the development data."""
    return rows.withColumns({f"risk_{name}": sigmoid_scores(rows, model) for name, model in frozen.items()})


def complete_pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys with value_oops_0, value_oops_1, value_zoops_0 and value_zoops_1, where all four cells (model, repeat, value) are there."""
    names = [f"{m}_{r}" for m in ("oops", "zoops") for r in (0, 1)]
    tagged = cells.withColumn("tag", F.concat_ws("_", "model", F.col("repeat").cast("string")))
    wide = tagged.groupBy(*keys).pivot("tag", names).agg(F.first("value"))
    return wide.select(*keys, *[F.col(n).alias(f"value_{n}") for n in names]).dropna(subset=[f"value_{n}" for n in names])
