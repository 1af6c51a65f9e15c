"""Fixed-effect regression from sums of products: centring, partial correlation, R2, resampling.

All statistics come from second moments of columns centred within cells. The moments of each
trajectory are a short row, so leaving trajectories out or drawing them again works on those
rows and never touches the data a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranking import drawn_weights
from helixframe.plans.materialise import broadcast_if_small


def centred(rows: DataFrame, cells: list[str], columns: list[str]) -> DataFrame:
    """rows with each column less its mean within the cell, by an aggregate and a join, so large cells spread over tasks."""
    means = rows.groupBy(*cells).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    joined = rows.join(means, cells)
    return joined.withColumns({c: F.col(c) - F.col(f"mean_{c}") for c in columns}).drop(*[f"mean_{c}" for c in columns])


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def moments(rows: DataFrame, cells: list[str], trajectory: str, columns: list[str]) -> DataFrame:
    """One row a cell and trajectory: n, sums s_ and sums of products p_ of the columns."""
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in _pairs(columns)]]
    return rows.groupBy(*cells, trajectory).agg(*sums)


def pooled(parts: DataFrame, cells: list[str], by: list[str], columns: list[str], weight: str | None = None) -> DataFrame:
    """by and the sums of products of columns centred within cells, from weighted moments."""
    w = F.col(weight) if weight else F.lit(1)
    names = ["n", *[f"s_{c}" for c in columns], *[f"p_{a}_{b}" for a, b in _pairs(columns)]]
    within = parts.groupBy(*by, *cells).agg(*[F.sum(F.col(c) * w).alias(c) for c in names])
    product = lambda a, b: F.sum(F.col(f"p_{a}_{b}") - F.when(F.col("n") > 0, F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")).otherwise(0.0)).alias(f"g_{a}_{b}")
    whole = [F.sum("n").alias("n"), *[product(a, b) for a, b in _pairs(columns)]]
    return within.groupBy(*by).agg(*whole) if by else within.agg(*whole)


def partial_statistics(gram: DataFrame, outcome: str, predictor: str, controls: list[str], columns: list[str]) -> DataFrame:
    """gram with within_r, partial_r, baseline_r2, full_r2 and delta_r2, each null where it is undefined.

    Controls (at most two) are taken out of outcome and predictor one after the other."""
    g = {}
    for a, b in _pairs(columns):
        g[a, b] = g[b, a] = F.col(f"g_{a}_{b}").cast("double")
    safe = lambda x, y: F.when(y > 1e-12, x / y)
    now = dict(g)
    for z in controls:
        size = now[z, z]
        new = {}
        for a in columns:
            for b in columns:
                share = F.coalesce(safe(now[a, z] * now[b, z], size), F.lit(0.0))
                new[a, b] = now[a, b] - share
        now = new
    r = lambda m: safe(m[outcome, predictor], F.sqrt(m[outcome, outcome] * m[predictor, predictor]))
    positive = lambda m: F.when((m[outcome, outcome] > 1e-9) & (m[predictor, predictor] > 1e-9), r(m))
    total = g[outcome, outcome]
    base = F.when(total > 1e-9, 1 - now[outcome, outcome] / total)
    more = F.coalesce(safe(now[outcome, predictor] * now[outcome, predictor], now[predictor, predictor]), F.lit(0.0))
    full = F.when(total > 1e-9, 1 - (now[outcome, outcome] - more) / total)
    return gram.withColumns({"within_r": positive(g), "partial_r": positive(now), "baseline_r2": base, "full_r2": full, "delta_r2": full - base})


def leave_one_out(parts: DataFrame, cells: list[str], trajectory: str, columns: list[str]) -> DataFrame:
    """The pooled sums without each trajectory in turn: omitted and the sums. parts is a table of cells times trajectories."""
    names = parts.select(F.col(trajectory).alias("omitted")).distinct()
    # every part but those of the omitted trajectory: the pooled sums less the trajectory's own would lose digits
    kept = parts.join(broadcast_if_small(names, 10_000), F.col(trajectory) != F.col("omitted"))
    return pooled(kept, cells, ["omitted"], columns)


def bootstrap_weights(parts: DataFrame, trajectory: str, replicates: int, seed: int, cohort: str | None = None) -> DataFrame:
    """(replicate, trajectory, weight): how often each trajectory is drawn, with replacement, in each replicate.

    With cohort, as many trajectories are drawn within each cohort as it has."""
    by = [cohort] if cohort else []
    names = parts.select(*by, trajectory).distinct()
    order = Window.partitionBy(*by).orderBy(trajectory)  # trajectories are a short list
    placed = broadcast_if_small(names.withColumn("k", (F.row_number().over(order) - 1).cast("bigint")))
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n")) if by else placed.agg(F.count("*").alias("n"))
    return drawn_weights(sizes, by, replicates, seed).join(placed, [*by, "k"]).select("replicate", *by, trajectory, "weight")


def cluster_bootstrap(parts: DataFrame, cells: list[str], trajectory: str, columns: list[str], outcome: str, predictor: str, controls: list[str], replicates: int, seed: int, cohort: str | None = None) -> DataFrame:
    """lower, upper and usable: the 95 % percentile interval of partial_r over drawn trajectories; undefined replicates drop out."""
    weights = broadcast_if_small(bootstrap_weights(parts, trajectory, replicates, seed, cohort))
    drawn = pooled(parts.join(weights, [*([cohort] if cohort else []), trajectory]), cells, ["replicate"], columns, "weight")
    r = partial_statistics(drawn, outcome, predictor, controls, columns).where("partial_r is not null")
    return r.agg(F.percentile("partial_r", F.lit(0.025)).alias("lower"), F.percentile("partial_r", F.lit(0.975)).alias("upper"), F.count("*").alias("usable"))


def transfer(train: DataFrame, test: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """rmse and r on test of a least-squares fit on train; features standardised by train. One row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scale = {c: stats[f"s_{c}"] or 1.0 for c in features}
    ready = lambda df: VectorAssembler(inputCols=features, outputCol="x_", handleInvalid="error").transform(df.select(*[((F.col(c) - stats[f"m_{c}"]) / scale[c]).alias(c) for c in features], F.col(outcome).alias("y_")))
    model = LinearRegression(featuresCol="x_", labelCol="y_", predictionCol="p_", solver="normal").fit(ready(train))
    judged = model.transform(ready(test))
    return judged.agg(F.sqrt(F.avg(F.pow(F.col("p_") - F.col("y_"), 2))).alias("rmse"), F.when((F.stddev_pop("p_") > 0) & (F.stddev_pop("y_") > 0), F.covar_pop("p_", "y_") / (F.stddev_pop("p_") * F.stddev_pop("y_"))).alias("r"))


def frozen_transfer(train: DataFrame, test: DataFrame, features: list[str], added: str, outcome: str) -> DataFrame:
    """baseline_rmse, baseline_r, augmented_rmse, augmented_r and delta_rmse: transfer() without and with one more feature. One row."""
    sides = [transfer(train, test, columns, outcome).select(F.col("rmse").alias(f"{name}_rmse"), F.col("r").alias(f"{name}_r"), F.lit(1).alias("one_")) for name, columns in (("baseline", features), ("augmented", [*features, added]))]
    return sides[0].join(sides[1], "one_").drop("one_").withColumn("delta_rmse", F.col("augmented_rmse") - F.col("baseline_rmse"))


def quantile_bounds(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """The least, the median and the greatest of a column."""
    return values.groupBy(*by).agg(F.min(column).alias("minimum"), F.median(column).alias("median"), F.max(column).alias("maximum"))


