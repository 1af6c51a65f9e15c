"""Evaluation of motifs as one job, and pairs of evaluated runs with checks of the whole grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.dna import with_pseudocount
from helixframe.operators.comparison import matches
from helixframe.operators.diagnostics import reference_results
from helixframe.operators.extensions import grid_difference, pair_features
from helixframe.operators.ranking import auroc, average_precision
from helixframe.operators.sequences import motif_distances, scan
from helixframe.plans.materialise import broadcast_if_small, checkpointed

#: The models, which begin the names of columns of pair tables (oops_ap, zoops_conf, weakest_log_confidence and so on).
MODELS = ("oops", "zoops")
#: What anchor and companion of a pair must have in common or must not.
SAME_INPUT = ("input", "meme_seed", "discovery_background")


def motif_scores(motifs: DataFrame, positives: DataFrame, negatives: DataFrame, background: dict[str, float], order: int, pseudocount: float) -> DataFrame:
    """run_id, doc_id, label and score: the best log odds of every sequence (doc_id, seq) under every motif (run_id, pwm, sites); fails on an id in both sets.

    Scores are rounded to nine digits, so that the same word scores alike wherever it stands."""
    both = positives.select("doc_id").join(negatives.select("doc_id"), "doc_id", "left_semi").take(1)
    if both:
        raise ValueError(f"positive and negative ids overlap: {both[0][0]}")
    smooth = motifs.select(F.col("run_id").alias("motif_id"), with_pseudocount(F.col("pwm"), F.col("sites"), pseudocount).alias("pwm"))
    sides = [scan(rows, smooth, background, order).withColumn("label", F.lit(label)) for rows, label in ((positives, 1), (negatives, 0))]
    return sides[0].unionByName(sides[1]).select(F.col("motif_id").alias("run_id"), "doc_id", "label", F.round("max_log_odds", 9).alias("score"))


def _metrics(scores: DataFrame) -> DataFrame:
    """run_id, positives, negatives, ap and auroc of motif_scores.

    Sequences are counted by score first: scores repeat where motifs are short, so what is kept and ranked are the distinct scores of a run."""
    counts = checkpointed(scores.groupBy("run_id", "label", "score").agg(F.count("*").alias("n_")))
    sums = counts.groupBy("run_id").agg(F.sum(F.col("label") * F.col("n_")).alias("positives"), F.sum((1 - F.col("label")) * F.col("n_")).alias("negatives"))
    ranks = average_precision(counts, ["run_id"], F.col("n_")).join(auroc(counts, ["run_id"], F.col("n_")), "run_id")
    return sums.join(ranks, "run_id")


def evaluated(motifs: DataFrame, positives: DataFrame, negatives: DataFrame, background: dict[str, float], order: int, pseudocount: float) -> DataFrame:
    """run_id, ap, auroc, positives, negatives, sites and site_fraction of every motif (run_id, pwm, sites, primary_count)."""
    found = _metrics(motif_scores(motifs, positives, negatives, background, order, pseudocount))
    own = motifs.select("run_id", "sites", (F.col("sites") / F.col("primary_count")).alias("site_fraction"))
    return own.join(broadcast_if_small(found), "run_id")


def evaluation_records(motifs: DataFrame, positives: DataFrame, negatives: DataFrame, catalogue: DataFrame, background: dict[str, float], order: int, pseudocount: float, overlap: int, protocol: str, done: DataFrame | None = None, score_path: str | None = None) -> DataFrame:
    """The evaluation of every frozen motif as one record: its run's own columns, metrics, identity and all matches with the catalogue.

    motifs has run_id, cohort, signal_percent, pwm, sites, primary_count and whatever else tells the run; these
    columns come back as they are. Added are evaluation_id, protocol, scoring_order, pseudocount,
    contamination_percent, ap, auroc, positives, negatives, site_fraction, motif_width, sample_size
    and matches, an array by target_id of target_id, p, e, q, shift, strand and overlap (empty without a match).

    Cells that done (run_id, protocol, scoring_order, pseudocount and pwm, as of earlier records) has are not evaluated
    again; one of another protocol, scoring or matrix fails. With score_path the scores of all sequences
    are written there as Parquet by cohort and run, each run's folder replaced as a whole."""
    _none(motifs.groupBy("run_id").count().where("count > 1"), "a run is there twice")
    todo = motifs
    if done is not None:
        met = motifs.select("run_id", F.col("pwm").alias("pwm_")).join(done, "run_id")
        same = F.col("pwm").cast("string").eqNullSafe(F.col("pwm_").cast("string")) & (F.col("protocol") == protocol) & (F.col("scoring_order") == order) & (F.col("pseudocount") == pseudocount)
        _none(met.where(~F.coalesce(same, F.lit(False))).select("run_id", "protocol", "scoring_order", "pseudocount"), "an earlier record is of another evaluation")
        todo = motifs.join(done.select("run_id"), "run_id", "left_anti")
    todo = checkpointed(todo)
    scores = motif_scores(todo, positives, negatives, background, order, pseudocount)
    if score_path is not None:
        scores = checkpointed(scores)
        named = scores.join(todo.select("run_id", "cohort"), "run_id").select("cohort", "run_id", F.col("doc_id").alias("sequence_id"), "label", F.col("score").alias("max_log_odds"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("cohort", "run_id").parquet(score_path)
    found = matches(todo.select(F.col("run_id").alias("query_id"), "pwm"), catalogue, overlap)
    each = F.struct("target_id", "p", "e", "q", "shift", "strand", "overlap")
    listed = found.groupBy(F.col("query_id").alias("run_id")).agg(F.array_sort(F.collect_list(each)).alias("matches"))  # as many as the catalogue has motifs
    own = todo.withColumns(
        {
            "evaluation_id": F.col("run_id"), "protocol": F.lit(protocol), "scoring_order": F.lit(order), "pseudocount": F.lit(float(pseudocount)), "contamination_percent": 100 - F.col("signal_percent"),
            "site_fraction": F.col("sites") / F.col("primary_count"), "motif_width": F.size("pwm"), "sample_size": F.col("primary_count"),
        }
    )
    whole = own.join(broadcast_if_small(_metrics(scores)), "run_id").join(listed, "run_id", "left")
    return whole.withColumn("matches", F.coalesce("matches", F.array().cast(listed.schema["matches"].dataType)))


def _none(rows: DataFrame, message: str) -> None:
    first = rows.take(1)
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def planned_cells(samples: DataFrame, levels: list[float]) -> DataFrame:
    """The grid of samples (sample), levels, two inputs and both models: sample, signal_percent, input_repeat, model."""
    every = lambda values: F.explode(F.array(*map(F.lit, values)))
    whole = samples.select("sample").distinct().withColumn("signal_percent", every([float(x) for x in levels]))
    return whole.withColumn("input_repeat", every([0, 1])).withColumn("model", every(MODELS))


def checked_cells(runs: DataFrame, grid: DataFrame, width: int, sample_size: int, background: str = "markov2") -> DataFrame:
    """runs, if they are the whole planned grid (sample, signal_percent, input_repeat, model), each cell once and of one protocol; else this fails."""
    if runs.select("cohort").distinct().limit(2).count() != 1:
        raise ValueError("one cohort at a time")
    _none(runs.where("order_repeat <> 0 or meme_repeat <> 0"), "audits are no primary observations")
    _none(runs.where((F.col("motif_width") != width) | (F.col("sample_size") != sample_size) | (F.col("background") != background)), "a run of another protocol")
    keys = ["sample", "signal_percent", "input_repeat", "model"]
    _none(runs.groupBy(*keys).count().where("count > 1"), "a cell is there twice")
    _none(grid_difference(grid, runs.select(*[F.col(c).cast(grid.schema[c].dataType).alias(c) for c in keys]), keys), "the grid is not whole")
    return runs


def checked_protocol(runs: DataFrame, protocol: str, scoring: tuple[int, float], reference: DataFrame, declared: DataFrame, target: str, overlap: int) -> DataFrame:
    """runs, if all were evaluated by this protocol against the declared reference; else this fails.

    runs has run_id, record_run_id (as the result itself says), protocol, scoring_order, pseudocount, meme_seed and
    motif_seed (as the motif says). reference and declared are catalogues (target_id, pwm); both
    must hold the target alone and the same matrix, and overlap must fit its width."""
    order, pseudocount = scoring
    _none(runs.where((F.col("scoring_order") != order) | (F.col("pseudocount") != pseudocount)), f"the protocol requires scoring order {order} and pseudocount {pseudocount}")
    _none(runs.where(~F.col("protocol").eqNullSafe(F.lit(protocol)) | ~F.col("record_run_id").eqNullSafe(F.col("run_id"))), "inconsistent evaluation records")
    _none(runs.where(~F.col("motif_seed").eqNullSafe(F.col("meme_seed"))), "the motif's seed differs from the evaluation record")
    for catalogue in (reference, declared):
        _none(catalogue.where(~F.col("target_id").eqNullSafe(F.lit(target))), "use only the declared target reference")
    widest = reference.agg(F.max(F.size("pwm"))).first()[0]
    if widest is None or not 0 < overlap <= widest:
        raise ValueError("invalid overlap with the reference")
    rows = lambda df: df.select("target_id", F.col("pwm").cast("string").alias("pwm"))
    _none(grid_difference(rows(reference), rows(declared), ["target_id", "pwm"]), "the reference differs from the declared one")
    return runs


def _cells(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys with a struct of the run's columns for each model and input: oops_0, oops_1, zoops_0, zoops_1; null where there is no run."""
    rest = F.struct(*[c for c in runs.columns if c not in (*keys, "model", "input_repeat")])
    each = [F.max(F.when((F.col("model") == m) & (F.col("input_repeat") == r), rest)).alias(f"{m}_{r}") for m in MODELS for r in (0, 1)]
    return runs.groupBy(*keys).agg(*each)


def _distances(pairs: DataFrame, a: str, b: str, name: str, fraction: float, clamp: bool = True, metric: str = "jsd", more: bool = False) -> DataFrame:
    """pairs with the distance of two matrices as name and, with more, its alignment."""
    found = motif_distances(pairs.withColumns({"a": F.col(a), "b": F.col(b)}), metric, fraction, clamp)
    out = found.withColumnRenamed("distance", name)
    out = out.withColumns({"alignment_offset": F.col("shift"), "alignment_strand": F.col("strand"), "alignment_overlap": F.col("overlap")}) if more else out
    return out.drop("a", "b", "shift", "strand", "overlap")


def paired_records(runs: DataFrame, found: DataFrame, target: str, overlap: int, limit: float, fraction: float = 0.8) -> DataFrame:
    """One row a sample and level, from checked runs: disagreement of both models, reference results, resampling distances and what diagnostics read.

    runs has cohort, sample, signal_percent, input_repeat, model, run_id, input, meme_seed,
    discovery_background, ap, auroc, neg_log10_evalue, site_fraction and pwm; found are matches as
    reference_results reads them. Fails where both models of an input differ in input, seed or
    background, where the companion is no separate input, or where its seed differs."""
    told = reference_results(runs, found, target, overlap, limit)
    cells = checkpointed(_cells(told, ["cohort", "sample", "signal_percent"]))
    other = F.lit(False)
    for r in (0, 1):
        for c in SAME_INPUT:
            other = other | ~F.col(f"oops_{r}.{c}").eqNullSafe(F.col(f"zoops_{r}.{c}"))
    shown = cells.select("sample", "signal_percent", other.alias("other"), (F.col("oops_0.input") == F.col("oops_1.input")).alias("again"), (F.col("oops_0.meme_seed") != F.col("oops_1.meme_seed")).alias("seeds"))
    _none(shown.where("other"), "both models of an input need the same input, seed and background")
    _none(shown.where("again"), "the companion must be a separate input")
    _none(shown.where("seeds"), "the companion must have the same seed")
    made = _distances(cells, "oops_0.pwm", "zoops_0.pwm", "disagreement", fraction, more=True)
    for m in MODELS:
        made = _distances(made, f"{m}_0.pwm", f"{m}_1.pwm", f"{m}_resampling", fraction)
    flat: dict[str, Column] = {"contamination_percent": 100 - F.col("signal_percent")}
    for m in MODELS:
        flat |= {f"{m}_reference_p": F.col(f"{m}_0.p"), f"{m}_reference_overlap": F.col(f"{m}_0.overlap"), f"{m}_weak_reference": F.col(f"{m}_0.weak"), f"{m}_ap": F.col(f"{m}_0.ap"), f"{m}_auroc": F.col(f"{m}_0.auroc"), f"{m}_neg_log10_evalue": F.col(f"{m}_0.neg_log10_evalue")}
    wide = made.withColumns(flat).withColumns({"weak_reference": F.greatest("oops_weak_reference", "zoops_weak_reference"), "zoops_site_fraction": F.col("zoops_0.site_fraction")})
    return pair_features(wide).drop(*[f"{m}_{r}" for m in MODELS for r in (0, 1)])


def compact_pairs(runs: DataFrame, fraction: float = 0.8, companions: bool = True) -> DataFrame:
    """The pair table of the extension analyses: anchors of which any of the four runs is missing are left out; distances are as they come, by all three metrics.

    Without companions only the two anchors must be there: a resampling distance whose companion is missing is null.

    runs has cohort, sample, signal_percent, motif_width, input_repeat, model, ap,
    neg_log10_evalue, site_fraction and pwm."""
    keys = ["cohort", "sample", "signal_percent", "motif_width"]
    made = checkpointed(_cells(runs, keys).dropna(subset=[f"{m}_{r}" for m in MODELS for r in ((0, 1) if companions else (0,))]))
    for metric in ("jsd", "tv", "hellinger"):
        made = _distances(made, "oops_0.pwm", "zoops_0.pwm", metric, fraction, False, metric)
    for m in MODELS:
        made = _distances(made, f"{m}_0.pwm", f"{m}_1.pwm", f"{m}_resampling", fraction, False)
    conf = lambda m: F.log1p(F.greatest(F.lit(0.0), F.col(f"{m}_0.neg_log10_evalue"))).alias(f"{m}_conf")
    return made.select("cohort", "sample", F.col("signal_percent").alias("signal"), F.col("motif_width").alias("width"), "jsd", "tv", "hellinger", *[F.col(f"{m}_0.ap").alias(f"{m}_ap") for m in MODELS], *map(conf, MODELS), F.col("zoops_0.site_fraction").alias("zoops_fraction"), "oops_resampling", "zoops_resampling")
