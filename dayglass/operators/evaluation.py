"""Detection quality: metrics, curves, sweeps, ranks.

Everything that needs an order over scores is read from a score ladder: a written
table of positives and negatives for each model and distinct score. Ladders of parts
of the predictions merge by addition, so a new day costs its own rows. ``score_steps``
adds running counts; every curve and area takes such a table, made from its predictions
where none is given. A model is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions.numeric import binary_label
from dayglass.functions.text import display_name
from dayglass.operators.ordering import (
    count_below,
    quantile_grid,
    quantiles,
    row_numbers,
    running_counts,
    top_rows,
    union_all,
    with_group_stats,
)
from dayglass.session import materialise


def _ratio(part: Column, whole: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def valid_rows(predictions: DataFrame) -> DataFrame:
    """Rows with label and prediction, both binarised."""
    kept = predictions.where(F.col("true_label").isNotNull() & F.col("prediction").isNotNull())
    return kept.withColumns(
        {
            "true_label": binary_label(F.col("true_label")),
            "prediction": binary_label(F.col("prediction")),
        }
    )


def score_ladder(predictions: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """``model, score, pos, neg``: one row per model and distinct score, in a written table."""
    y = binary_label(F.col("true_label"))
    counted = predictions.where(F.col(score).isNotNull()).groupBy("model", F.col(score).alias("score"))
    return materialise(counted.agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")), "score-ladder")


def merge_ladders(ladders: list[DataFrame]) -> DataFrame:
    """The ladder of all predictions together, from ladders of disjoint parts of them."""
    merged = union_all(ladders).groupBy("model", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return materialise(merged, "score-ladder")


def climb(ladder: DataFrame) -> DataFrame:
    """A written ladder from its highest score down: running counts ``cum_*`` and the model's ``total_*``."""
    steps = running_counts(ladder, "score", ["pos", "neg"], ("model",), descending=True)
    totals = {"total_pos": F.sum("pos"), "total_neg": F.sum("neg")}
    return with_group_stats(steps, ["model"], totals, source=ladder)


def score_steps(predictions: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Per model and distinct score, descending: positives, negatives and running counts."""
    return climb(score_ladder(predictions, score))


def auc_roc(predictions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``model, auc_roc``: trapezoid area with ties, 0 when only one class is present."""
    steps = steps or score_steps(predictions)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return steps.groupBy("model").agg(
        _ratio(area, F.max(F.col("total_pos").cast("double") * F.col("total_neg"))).alias("auc_roc")
    )


def metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC and the four counts, one row per model.

    When labels and predictions hold a single class the four counts are 0.
    """
    rows = valid_rows(predictions)
    y, p = F.col("true_label"), F.col("prediction")
    counted = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    one_class = (tn == n) | (tp == n)

    def shown(c: Column) -> Column:
        return F.when(one_class, F.lit(0)).otherwise(c).cast("long")

    # one row per model on both sides
    return counted.join(auc_roc(rows), "model", "left").select(
        "model",
        _ratio(tp + tn, n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
        F.coalesce("auc_roc", F.lit(0.0)).alias("auc_roc"),
        shown(tn).alias("true_negatives"),
        shown(fp).alias("false_positives"),
        shown(fn).alias("false_negatives"),
        shown(tp).alias("true_positives"),
    )


def roc_points(predictions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``model, threshold, fpr, tpr`` for every distinct score plus the start at infinity."""
    steps = steps or score_steps(predictions)
    points = steps.select(
        "model",
        F.col("score").cast("double").alias("threshold"),
        _ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )
    start = predictions.select("model").distinct().select(
        "model", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_points(predictions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``model, threshold, precision, recall`` plus the closing point (1, 0) without threshold."""
    steps = steps or score_steps(predictions)
    points = steps.select(
        "model",
        F.col("score").cast("double").alias("threshold"),
        _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )
    end = predictions.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def pr_summary(predictions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``model, average_precision, pr_auc``: step sum and trapezoid area under the PR curve."""
    steps = steps or score_steps(predictions)
    tp, both = F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")
    before_tp = tp - F.col("pos")
    before_both = both - F.col("pos") - F.col("neg")
    precision = _ratio(tp, both)
    # in front of the first step precision is 1 by definition
    earlier = F.when(before_both == 0, F.lit(1.0)).otherwise(_ratio(before_tp, before_both))
    gain = _ratio(F.col("pos"), F.col("total_pos"))
    return steps.groupBy("model").agg(
        F.sum(gain * precision).alias("average_precision"),
        F.sum(gain * (precision + earlier) / 2.0).alias("pr_auc"),
    )


def best_f1_on_curve(predictions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Point of the PR curve with the highest F1 per model, the lowest threshold on ties."""
    steps = steps or score_steps(predictions)
    tp, fp, fn = F.col("cum_pos"), F.col("cum_neg"), F.col("total_pos") - F.col("cum_pos")
    points = steps.select(
        "model",
        F.col("score").cast("double").alias("threshold"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
    )
    row = F.struct("threshold", "precision", "recall", "f1_score")
    order = F.struct(F.col("f1_score"), -F.col("threshold"))
    return points.groupBy("model").agg(F.max_by(row, order).alias("b")).select("model", "b.*")


def confusion(predictions: DataFrame) -> DataFrame:
    """Four rows per model, zeros included: ``model, true_label, prediction, n``."""
    rows = valid_rows(predictions)
    counts = rows.groupBy("model").agg(
        *[
            F.count_if((F.col("true_label") == y) & (F.col("prediction") == p)).alias(f"c{y}{p}")
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(y).alias("true_label"), F.lit(p).alias("prediction"), F.col(f"c{y}{p}").alias("n"))
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    return counts.select("model", F.inline(cells))


# --- threshold sweeps -------------------------------------------------------


def _sweep(binned: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Quality at each threshold from counts of scores by "thresholds below".

    ``binned``: ``model, below, pos, neg``; a score is flagged at threshold
    ``i`` when ``below > i``. ``thresholds``: ``model, step, threshold``. Both
    have at most one row per model and threshold.
    """
    grid = thresholds.select(
        "model", (F.col("step") + 1).cast("long").alias("below"), F.lit(0).alias("pos"), F.lit(0).alias("neg"), "threshold"
    )
    counted = binned.select(
        "model", F.col("below").cast("long").alias("below"), "pos", "neg", F.lit(None).cast("double").alias("threshold")
    )
    cells = grid.unionByName(counted).groupBy("model", "below").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("threshold").alias("threshold")
    )
    whole = Window.partitionBy("model")
    from_top = whole.orderBy(F.desc("below")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = cells.select(
        "model",
        (F.col("below") - 1).alias("step"),
        "threshold",
        F.sum("pos").over(from_top).alias("tp"),
        F.sum("neg").over(from_top).alias("fp"),
        F.sum("pos").over(whole).alias("_p"),
    ).where(F.col("step") >= 0)
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("_p") - tp
    return running.select(
        "model",
        "step",
        "threshold",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
        "tp",
        "fp",
        fn.alias("fn"),
    )


def threshold_sweep(
    predictions: DataFrame,
    steps: int = config.THRESHOLD_STEPS,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Precision, recall and F1 at ``steps`` evenly spaced thresholds (strictly above).

    Bounds default to each model's own score range. Every score is put into
    the bin of its threshold, so rows are never multiplied by thresholds.
    """
    rows = predictions.select(
        "model", F.col("anomaly_score").alias("s"), binary_label(F.col("true_label")).alias("y")
    ).where(F.col("s").isNotNull())
    bounds = {
        "_lo": F.min("s") if low is None else F.max(F.lit(float(low))),
        "_hi": F.max("s") if high is None else F.max(F.lit(float(high))),
    }
    bound = with_group_stats(rows, ["model"], bounds)
    last = steps - 1
    gap = (F.col("_hi") - F.col("_lo")) / last

    def at(i: Column) -> Column:
        return F.when(i == last, F.col("_hi")).otherwise(F.col("_lo") + i * gap)

    # arithmetic guess, then exact comparison with the three thresholds around it
    guess = F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("_lo"), gap)), F.lit(0))
    near = F.greatest(F.lit(-2), F.least(guess, F.lit(steps + 1))).cast("long")
    below = F.greatest(near - 1, F.lit(0))
    for d in (-1, 0, 1):
        i = near + d
        hit = (i >= 0) & (i <= last) & (at(i) < F.col("s"))
        below = below + hit.cast("long")
    binned = (
        bound.select("model", below.alias("below"), "y")
        .groupBy("model", "below")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    grid = (
        rows.groupBy("model")
        .agg(*[c.alias(n) for n, c in bounds.items()])
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("step"))
        .select("model", "step", at(F.col("step")).alias("threshold"))
    )
    return _sweep(binned, grid)


def candidate_sweep(predictions: DataFrame) -> DataFrame:
    """Sweep over every distinct score of a model (strictly above), however many there are."""
    score = F.coalesce(F.nanvl("anomaly_score", F.lit(0.0)), F.lit(0.0))
    ladder = score_ladder(predictions.withColumn("threshold", score), "threshold")
    steps = running_counts(ladder.withColumn("one", F.lit(1)), "score", ["pos", "neg", "one"], ("model",))
    bound = with_group_stats(steps, ["model"], {"_p": F.sum("pos"), "_n": F.sum("neg")}, source=ladder)
    tp, fp, fn = F.col("_p") - F.col("cum_pos"), F.col("_n") - F.col("cum_neg"), F.col("cum_pos")
    return bound.select(
        "model",
        (F.col("cum_one") - 1).cast("long").alias("step"),
        F.col("score").alias("threshold"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
    )


def quantile_sweep(predictions: DataFrame, steps: int = config.GRID_STEPS) -> DataFrame:
    """Sweep over ``steps`` evenly spaced quantiles of a model's scores (strictly above)."""
    rows = predictions.select(
        "model",
        F.coalesce(F.nanvl("anomaly_score", F.lit(0.0)), F.lit(0.0)).alias("s"),
        binary_label(F.col("true_label")).alias("y"),
    )
    # at most ``steps`` thresholds a model
    grid = quantile_grid(rows, "s", steps, ("model",))
    lists = grid.groupBy("model").agg(F.sort_array(F.collect_set("quantile")).alias("points"))
    blocked = lists.select("model", F.struct("points", F.filter("points", lambda _, i: i % 32 == 0).alias("heads")).alias("_t"))
    distinct = rows.groupBy("model", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    bound = with_group_stats(distinct, ["model"], {"_t": F.first("_t")}, source=blocked)
    binned = (
        bound.select("model", count_below("_t", F.col("s")).alias("below"), "pos", "neg")
        .groupBy("model", "below")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    return _sweep(binned, lists.select("model", F.posexplode("points").alias("step", "threshold")))


def best_threshold(sweep: DataFrame, default: float | None = None) -> DataFrame:
    """Per model the first step with the highest F1 above 0.

    A model whose F1 is never above 0 gives no row, or ``default`` as threshold.
    """
    row = F.struct("threshold", "f1_score", "precision", "recall")
    order = F.struct(F.col("f1_score"), -F.col("step"))
    best = sweep.groupBy("model").agg(F.max_by(row, order).alias("b")).select("model", "b.*")
    if default is None:
        return best.where(F.col("f1_score") > 0)
    good = F.col("f1_score") > 0
    return best.select(
        "model",
        F.when(good, F.col("threshold")).otherwise(F.lit(float(default))).alias("threshold"),
        *[F.when(good, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("f1_score", "precision", "recall")],
    )


def full_recall_threshold(predictions: DataFrame) -> DataFrame:
    """Best threshold (``>=``) that keeps every positive: the lowest positive score.

    Any lower one only adds false alarms. Models without positives give no row.
    """
    rows = predictions.select(
        "model", F.col("anomaly_score").alias("s"), binary_label(F.col("true_label")).alias("y")
    )
    bound = with_group_stats(rows, ["model"], {"threshold": F.min(F.when(F.col("y") == 1, F.col("s")))})
    hit = F.col("s") >= F.col("threshold")
    y = F.col("y")
    counted = (
        bound.where(F.col("threshold").isNotNull())
        .groupBy("model")
        .agg(
            F.max("threshold").alias("threshold"),
            F.count_if(~hit & (y == 0)).alias("tn"),
            F.count_if(hit & (y == 0)).alias("fp"),
            F.count_if(~hit & (y == 1)).alias("fn"),
            F.count_if(hit & (y == 1)).alias("tp"),
        )
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counted.select(
        "model",
        "threshold",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def recalibrate(
    predictions: DataFrame, low: float = 0.9, high: float = 0.999, steps: int = 100, default: float = 0.5
) -> DataFrame:
    """Predictions under the best threshold of a fixed range, and that threshold."""
    best = best_threshold(threshold_sweep(predictions, steps, low, high), default)
    bound = with_group_stats(predictions, ["model"], {"threshold": F.max("threshold")}, source=best)
    return bound.withColumn("prediction", (F.col("anomaly_score") > F.col("threshold")).cast("int"))


# --- ranks ------------------------------------------------------------------


def precision_at_k(
    predictions: DataFrame, ks: tuple[int, ...] = config.TOP_KS, keys: tuple[str, ...] = ("user", "day")
) -> DataFrame:
    """``model, k, precision_at_k, recall_at_k``; a k above the row count is left out."""
    rows = predictions.select(
        "model", *keys, F.col("anomaly_score").alias("s"), binary_label(F.col("true_label")).alias("y")
    )
    top = top_rows(rows, [F.desc("s"), *[F.asc(k) for k in keys]], max(ks), ("model",))
    hits = top.groupBy("model").agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0)).alias(f"h{k}") for k in ks]
    )
    totals = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])
    wide = totals.join(hits, "model").select("model", "n", "p", F.inline(cells))
    return wide.where(F.col("k") <= F.col("n")).select(
        "model", "k", _ratio(F.col("h"), F.col("k")).alias("precision_at_k"), _ratio(F.col("h"), F.col("p")).alias("recall_at_k")
    )


def recall_at_fpr(
    predictions: DataFrame, levels: tuple[float, ...] = config.FPR_LEVELS, steps: DataFrame | None = None
) -> DataFrame:
    """``model, max_fpr, recall``: recall at the last curve point within the rate."""
    points = roc_points(predictions, steps)
    best = points.groupBy("model").agg(
        *[F.max(F.when(F.col("fpr") <= v, F.col("tpr"))).alias(f"r{i}") for i, v in enumerate(levels)]
    )
    cells = F.array(
        *[F.struct(F.lit(v).alias("max_fpr"), F.col(f"r{i}").alias("recall")) for i, v in enumerate(levels)]
    )
    return best.select("model", F.inline(cells))


def positive_ranks(
    predictions: DataFrame, keys: tuple[str, ...] = ("user", "day"), stored: bool = False
) -> DataFrame:
    """Rank of every positive by descending score (key breaks ties) and its top percentage.

    ``stored``: the predictions are a written table already.
    """
    rows = predictions.select(
        "model", *keys, "anomaly_score", binary_label(F.col("true_label")).alias("true_label")
    )
    if not stored:
        rows = materialise(rows, "ranked-predictions")
    order = [-F.col("anomaly_score"), *[F.col(k) for k in keys]]
    ranked = row_numbers(rows, order, ("model",), out="rank", stored=True)
    sized = with_group_stats(ranked, ["model"], {"_n": F.count(F.lit(1))}, source=rows)
    return sized.where(F.col("true_label") == 1).select(
        "model", *keys, "anomaly_score", "rank", (100.0 * F.col("rank") / F.col("_n")).alias("top_pct")
    )


def rank_summary(predictions: DataFrame, keys: tuple[str, ...] = ("user", "day")) -> DataFrame:
    return positive_ranks(predictions, keys).groupBy("model").agg(
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.avg("rank").alias("avg_rank")
    )


# --- tables and checks ------------------------------------------------------


def comparison_table(predictions: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Display name and rounded metrics per model; ``extra`` rows keep their own name."""
    columns = ["accuracy", "precision", "recall", "f1_score", "auc_roc"]
    rounded = [F.round(c, 4).alias(c) for c in columns]
    table = metrics(predictions).select(display_name(F.col("model")).alias("model"), *rounded)
    if extra is None:
        return table
    return table.unionByName(metrics(extra).select("model", *rounded))


def imbalance_table(
    predictions: DataFrame, keys: tuple[str, ...] = ("user", "day"), ks: tuple[int, ...] = (50, 100)
) -> DataFrame:
    """Counts, imbalance ratio, AUC, precision@k, recall at FPR and ranks, for models with positives.

    The predictions are read once. Areas and recalls come from one ladder of the stored
    rows; a positive's rank tells in which of the first k it counts. A k above the number
    of a model's rows is left null.
    """
    wanted = predictions.select("model", *keys, "anomaly_score", "true_label")
    rows = materialise(wanted, "imbalance-rows")
    base = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(binary_label(F.col("true_label"))).alias("n_insiders")
    ).where(F.col("n_insiders") > 0)
    steps = score_steps(rows)
    # areas and recalls in one pass over the steps
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    fpr, tpr = _ratio(F.col("cum_neg"), F.col("total_neg")), _ratio(F.col("cum_pos"), F.col("total_pos"))
    levels = {f"recall_at_{round(v * 100)}pct_fpr": v for v in (0.05, 0.10)}
    curves = steps.groupBy("model").agg(
        _ratio(area, F.max(F.col("total_pos").cast("double") * F.col("total_neg"))).alias("auc_roc"),
        *[F.coalesce(F.max(F.when(fpr <= v, tpr)), F.lit(0.0)).alias(n) for n, v in levels.items()],
    )
    ranks = positive_ranks(rows, keys, stored=True).groupBy("model").agg(
        F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"),
        F.avg("rank").alias("avg_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"_hits_{k}") for k in ks],
    )
    # every side has one row per model
    joined = base.join(curves, "model", "left").join(ranks, "model", "left")
    return joined.select(
        display_name(F.col("model")).alias("model"),
        "n_samples",
        "n_insiders",
        F.concat(F.lit("1:"), F.floor(F.col("n_samples") / F.col("n_insiders")).cast("string")).alias("imbalance_ratio"),
        F.coalesce("auc_roc", F.lit(0.0)).alias("auc_roc"),
        *[F.when(F.col("n_samples") >= k, _ratio(F.col(f"_hits_{k}"), F.lit(k))).alias(f"precision_at_{k}") for k in ks],
        *levels,
        "best_rank",
        "worst_rank",
        "avg_rank",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str = "is_insider") -> DataFrame:
    """Total, normal and positive counts, positive percentage and normals per positive."""
    y = F.coalesce(F.col(label), F.lit(0)) > 0
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~y).alias("normal"), F.count_if(y).alias("insider"))
    return counts.select(
        "total",
        "normal",
        "insider",
        (100.0 * _ratio(F.col("insider"), F.col("total"))).alias("insider_pct"),
        F.try_divide(F.col("normal").cast("double"), F.col("insider").cast("double")).alias("normals_per_insider"),
    )


def labelled_user_breakdown(events: DataFrame, user: str = "user_id", kind: str = "activity_type") -> DataFrame:
    """Per labelled user: event count and a map from kind to count."""
    per_kind = (
        events.where(F.col("is_insider") == 1)
        .groupBy(user, kind)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one entry per kind of activity
    entries = F.sort_array(F.collect_list(F.struct(F.coalesce(kind, F.lit("UNKNOWN")).alias("kind"), "n")))
    return per_kind.groupBy(user).agg(
        F.sum("n").alias("records"), F.map_from_entries(entries).alias("by_type")
    )


def lost_positives(static: DataFrame, windows: DataFrame, static_label: str = "is_insider") -> DataFrame:
    """Positives among users and among sequences, as two rows."""
    left = static.agg(F.lit("static").alias("stage"), F.count_if(F.col(static_label) > 0).alias("positives"))
    right = windows.agg(F.lit("sequences").alias("stage"), F.count_if(F.col("label") > 0).alias("positives"))
    return left.unionByName(right)


def score_distribution(predictions: DataFrame) -> DataFrame:
    """Min, max, mean, median, population std and high percentiles per model."""
    probs = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    basic = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("anomaly_score").alias("min_score"),
        F.max("anomaly_score").alias("max_score"),
        F.avg("anomaly_score").alias("mean_score"),
        F.stddev_pop("anomaly_score").alias("std_score"),
    )
    return basic.join(quantiles(predictions, "anomaly_score", probs, ("model",)), "model")


def mean_score_by_label(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", binary_label(F.col("true_label")).alias("label")).agg(
        F.avg("anomaly_score").alias("mean_score"), F.count(F.lit(1)).alias("n")
    )


def score_histogram(predictions: DataFrame, bins: int = config.HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins over each model's and class's own range; the maximum is in the last bin.

    One value only: as in NumPy, the range is widened by half on both sides.
    """
    rows = predictions.select(
        "model", binary_label(F.col("true_label")).alias("label"), F.col("anomaly_score").alias("s")
    ).where(F.col("s").isNotNull())
    bound = with_group_stats(rows, ["model", "label"], {"_lo": F.min("s"), "_hi": F.max("s")})
    flat = F.col("_lo") == F.col("_hi")
    low = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    high = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    place = F.floor((F.col("s") - low) / (high - low) * bins)
    return (
        bound.select("model", "label", F.least(place, F.lit(bins - 1)).cast("long").alias("bin"), low.alias("lo"), high.alias("hi"))
        .groupBy("model", "label", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max("lo").alias("range_low"), F.max("hi").alias("range_high"))
    )


def health_check(predictions: DataFrame) -> DataFrame:
    """Balance of labels and predictions and three warning flags per model."""
    y, p = binary_label(F.col("true_label")), binary_label(F.col("prediction"))
    counts = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("long").alias("positive_labels"),
        F.sum(p).cast("long").alias("positive_predictions"),
        F.stddev_pop("anomaly_score").alias("std_score"),
    )
    n = F.col("n")
    return counts.select(
        "model",
        "n",
        "positive_labels",
        (100.0 * F.col("positive_labels") / n).alias("label_pct"),
        "positive_predictions",
        (100.0 * F.col("positive_predictions") / n).alias("prediction_pct"),
        (F.col("positive_labels") == 0).alias("no_positive_labels"),
        (F.col("positive_predictions") == 0).alias("no_positive_predictions"),
        (F.col("std_score") < 0.01).alias("scores_nearly_equal"),
    )


def executive_summary(
    predictions: DataFrame, ensemble_rows: DataFrame, alerts: DataFrame
) -> dict[str, DataFrame]:
    """The four tables of the summary: comparison, severity shares, ROC points, top alerts."""
    from dayglass.operators.alerts import severity_counts, top_alerts

    return {
        "comparison": comparison_table(predictions, ensemble_rows),
        "severity": severity_counts(alerts),
        "roc": roc_points(union_all([predictions, ensemble_rows])),
        "top_alerts": top_alerts(alerts, 10),
    }


def evaluation_report(predictions: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Comparison table with a flag on the best model by F1 (one row per model)."""
    table = comparison_table(predictions, extra)
    first = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1_score"), F.asc("model"))
    return table.withColumn("is_best", F.row_number().over(first) == 1)
