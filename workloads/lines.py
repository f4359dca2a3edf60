"""Score streams over ``lineitem``: curves, ranking, thresholds, metrics, calibration data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.scaling import written
from riskfold.operators import curves, summaries, thresholds
from riskfold.plans import reporting

TARGETS = (0.90, 0.85, 0.80)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: fold, label and three scores."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5 + 1).alias("fold_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_discount") * 10).alias("disc"),
        (F.col("l_quantity") / 50).alias("qty"),
        (F.col("l_extendedprice") / 105000).alias("price"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.long_streams(
        wide_scores(spark, sf_dir), ["fold_id", "y_true"], {m: m for m in ("disc", "qty", "price")}
    )


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded fractions, null for infinities."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(F.abs(c) != float("inf"), c), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def _curve(spark, sf_dir):
    return curves.cumulative_curve(scores(spark, sf_dir))


def _metrics(spark, sf):
    return thresholds.oof_threshold_metrics(scores(spark, sf), targets=TARGETS)


def _fold_metrics(spark, sf):
    return thresholds.fold_threshold_metrics(scores(spark, sf), targets=TARGETS)


def _predictions(spark, sf):
    """Counts of the 0/1 column of every threshold, over every row."""
    s = scores(spark, sf)
    return (
        thresholds.thresholded_predictions(s, thresholds.threshold_set(curves.cumulative_curve(s)))
        .groupBy("model", "threshold_name", "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _prediction_columns(spark, sf):
    """The same counts from the wide table with one 0/1 column per model and threshold."""
    thr = thresholds.threshold_set(_curve(spark, sf))
    streams = {m: m for m in ("disc", "qty", "price")}
    wide = thresholds.thresholded_columns(wide_scores(spark, sf), streams, thr)
    names = [c for c in wide.columns if c.startswith("y_pred__")]
    cells = F.array(
        *[
            F.struct(
                F.lit(c.split("__", 2)[1]).alias("model"),
                F.lit(c.split("__", 2)[2]).alias("threshold_name"),
                F.col(f"`{c}`").alias("y_pred"),
            )
            for c in names
        ]
    )
    return (
        wide.select("y_true", F.inline(cells))
        .groupBy("model", "threshold_name", "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fold_summary(spark, sf):
    ranking = written(curves.fold_ranking(scores(spark, sf)), "fold-ranking")
    both = summaries.fold_summary(ranking, ddof=1).join(
        summaries.fold_summary(ranking, ddof=0).select(
            "model", F.col("auc_sd").alias("auc_sd_pop"), F.col("auprc_sd").alias("auprc_sd_pop")
        ),
        "model",
    )
    return both


def _model_reports(spark, sf):
    """One row per model and threshold of the nested report: totals, folds, means, deviations."""
    report = reporting.model_reports(scores(spark, sf), targets=TARGETS)
    out = report.select("*", F.explode("thresholds").alias("threshold_name", "at"))
    over = F.col("fold_metrics")[F.col("threshold_name")]
    ranking = [
        F.col(f"fold_ranking.{m}.{part}").alias(f"{m}_{part}")
        for m in reporting.RANKING for part in ("mean", "sd", "sd_pop")
    ]
    spread = [
        over[m][part].alias(f"{m}_{part}")
        for m in thresholds.SUMMARY_METRICS for part in ("mean", "sd")
    ]
    return out.select(
        "model", "n", "n_pos", "n_neg", "prevalence", "oof_auc", "oof_auprc", "threshold_name",
        "at.threshold", "at.tp", "at.fp", "at.tn", "at.fn", F.size("folds").alias("n_folds"),
        F.aggregate("folds", F.lit(0).cast("bigint"), lambda a, f: a + f["n"]).alias("n_in_folds"),
        F.element_at("folds", 1)["auc"].alias("first_auc"), *ranking, *spread,
    )


def _ranked(spark, sf):
    """AUC and average precision best first, Brier score lowest first."""
    s = scores(spark, sf)
    ranking, brier = curves.oof_ranking(s), summaries.brier_score(s)
    parts = [
        (ranking.select("model", F.col("oof_auc").alias("value")), "auc", False),
        (ranking.select("model", F.col("oof_auprc").alias("value")), "auprc", False),
        (brier.select("model", F.col("brier").alias("value")), "brier", True),
    ]
    out = [
        summaries.rank_models(df, "value", asc).select(
            F.lit(name).alias("metric"), "model", "value", F.col("position").cast("bigint")
        )
        for df, name, asc in parts
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {
    "performance_matrix": lambda s, d: tidy(thresholds.performance_matrix(scores(s, d))),
    "roc_points": lambda s, d: tidy(curves.roc_points(scores(s, d))),
    "roc_points_no_collinear": lambda s, d: tidy(
        curves.roc_points(scores(s, d), drop_collinear=True)
    ),
    "pr_points": lambda s, d: tidy(curves.pr_points(scores(s, d))),
    "roc_auc": lambda s, d: tidy(curves.roc_auc(scores(s, d))),
    "average_precision": lambda s, d: tidy(curves.average_precision(scores(s, d))),
    "oof_ranking": lambda s, d: tidy(curves.oof_ranking(scores(s, d))),
    "fold_ranking": lambda s, d: tidy(curves.fold_ranking(scores(s, d))),
    "sweep_f1": lambda s, d: tidy(thresholds.sweep_f1(_curve(s, d))),
    "sweep_youden": lambda s, d: tidy(thresholds.sweep_youden(curves.roc_points(scores(s, d)))),
    "sweep_recall": lambda s, d: tidy(thresholds.sweep_recall(_curve(s, d), TARGETS)),
    "pick_f1": lambda s, d: tidy(thresholds.pick_f1(_curve(s, d))),
    "pick_youden": lambda s, d: tidy(thresholds.pick_youden(_curve(s, d))),
    "pick_recall": lambda s, d: tidy(thresholds.pick_recall(_curve(s, d), 0.90)),
    "threshold_set": lambda s, d: tidy(thresholds.threshold_set(_curve(s, d), targets=TARGETS)),
    "metrics_at_threshold": lambda s, d: tidy(
        thresholds.metrics_at_threshold(
            scores(s, d), thresholds.threshold_set(_curve(s, d), targets=TARGETS)
        )
    ),
    "join_thresholds": lambda s, d: thresholds.join_thresholds(
        scores(s, d), thresholds.threshold_set(_curve(s, d), targets=TARGETS)
    )
    .groupBy("model", "threshold_name")
    .agg(F.count(F.lit(1)).alias("n")),
    "oof_threshold_metrics": lambda s, d: tidy(_metrics(s, d)),
    "fold_threshold_metrics": lambda s, d: tidy(_fold_metrics(s, d)),
    "thresholded_predictions": _predictions,
    "thresholded_predictions_wide": _prediction_columns,
    "fold_summary": lambda s, d: tidy(_fold_summary(s, d)),
    "model_reports": lambda s, d: tidy(_model_reports(s, d)),
    "fold_threshold_summary": lambda s, d: tidy(
        summaries.fold_threshold_summary(_fold_metrics(s, d))
    ),
    "cohort_summary": lambda s, d: tidy(summaries.cohort_summary(wide_scores(s, d))),
    "rank_models": lambda s, d: tidy(_ranked(s, d), 8),
    "brier_score": lambda s, d: tidy(summaries.brier_score(scores(s, d)), 8),
    "reliability_curve": lambda s, d: tidy(summaries.reliability_curve(scores(s, d))),
}

# ---------------------------------------------------------------- oracles

SCORES_SQL = """
  lines AS (
    SELECT l_orderkey % 5 + 1 AS fold_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
           l_discount * 10 AS disc, l_quantity / 50 AS qty, l_extendedprice / 105000 AS price
    FROM lineitem),
  scores AS (
    SELECT 'disc' AS model, fold_id, y_true, disc AS p FROM lines
    UNION ALL SELECT 'qty', fold_id, y_true, qty FROM lines
    UNION ALL SELECT 'price', fold_id, y_true, price FROM lines)"""


def curve_sql(by: str = "model", source: str = "scores", name: str = "curve") -> str:
    """Plain single-window form of the cumulative curve."""
    return f"""
  {name}_g AS (
    SELECT {by}, p, CAST(SUM(y_true) AS BIGINT) AS pos, COUNT(*) AS n FROM {source} GROUP BY {by}, p),
  {name} AS (
    SELECT {by}, p, pos, n, CAST(SUM(pos) OVER w AS BIGINT) AS tp,
           CAST(SUM(n - pos) OVER w AS BIGINT) AS fp,
           CAST(SUM(pos) OVER a AS BIGINT) AS tot_pos, CAST(SUM(n - pos) OVER a AS BIGINT) AS tot_neg,
           LEAD(pos) OVER v AS next_pos, LEAD(n) OVER v AS next_n
    FROM {name}_g
    WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           v AS (PARTITION BY {by} ORDER BY p DESC), a AS (PARTITION BY {by}))"""


AUC = "SUM((n - pos) * (2.0 * tp - pos)) / (2.0 * MAX(tot_pos) * MAX(tot_neg))"
AP = "SUM((1.0 * pos / tot_pos) * (1.0 * tp / (tp + fp)))"
PREC, REC, FPR = "CAST(tp AS DOUBLE) / (tp + fp)", "CAST(tp AS DOUBLE) / tot_pos", "CAST(fp AS DOUBLE) / tot_neg"
SWEEP_SQL = f"""
  sweep AS (
    SELECT *, 2 * prec * rec / GREATEST(prec + rec, 1e-12) AS f1, rec - fpr AS j
    FROM (SELECT *, {PREC} AS prec, {REC} AS rec, {FPR} AS fpr FROM curve))"""
PICKS_SQL = """
  picks AS (
    SELECT model, 'fixed' AS threshold_name, 0.5::DOUBLE AS threshold FROM sweep GROUP BY model
    UNION ALL SELECT model, 'f1_opt', p FROM (
      SELECT model, p, ROW_NUMBER() OVER (PARTITION BY model ORDER BY f1 DESC, p) AS r FROM sweep) WHERE r = 1
    UNION ALL SELECT model, 'youden_j_opt', CASE WHEN j > 0 THEN p ELSE 'inf'::DOUBLE END FROM (
      SELECT model, p, j, ROW_NUMBER() OVER (PARTITION BY model ORDER BY j DESC, p DESC) AS r FROM sweep) WHERE r = 1
    UNION ALL SELECT model, 'recall_0.90', MAX(p) FROM sweep WHERE rec >= 0.90 GROUP BY model
    UNION ALL SELECT model, 'recall_0.85', MAX(p) FROM sweep WHERE rec >= 0.85 GROUP BY model
    UNION ALL SELECT model, 'recall_0.80', MAX(p) FROM sweep WHERE rec >= 0.80 GROUP BY model)"""


def _confusion_sql(by: str, extra: str = "") -> str:
    return f"""
  confusion AS (
    SELECT {by}, threshold_name, threshold,
           COUNT(*) FILTER (WHERE p >= threshold AND y_true = 1) AS tp,
           COUNT(*) FILTER (WHERE p >= threshold AND y_true = 0) AS fp,
           COUNT(*) FILTER (WHERE p < threshold AND y_true = 0) AS tn,
           COUNT(*) FILTER (WHERE p < threshold AND y_true = 1) AS fn
    FROM scores JOIN picks USING (model) GROUP BY {by}, threshold_name, threshold),
  rates AS (
    SELECT *, COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0) AS precision_,
           COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0) AS recall_,
           COALESCE(tn / NULLIF(tn + fp, 0)::DOUBLE, 0) AS spec_,
           COALESCE(fp / NULLIF(fp + tn, 0)::DOUBLE, 0) AS fpr_,
           COALESCE(tn / NULLIF(tn + fn, 0)::DOUBLE, 0) AS npv_,
           COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1_
    FROM confusion)"""


def _finite(expr: str, name: str) -> str:
    return f"ROUND(CASE WHEN isinf({expr}) THEN NULL ELSE {expr} END, 6) AS {name}"


METRICS_SELECT = f"""{_finite('threshold', 'threshold')}, tp, fp, tn, fn,
  ROUND(precision_, 6) AS precision, ROUND(recall_, 6) AS recall, ROUND(f1_, 6) AS f1,
  ROUND((recall_ + spec_) / 2, 6) AS balanced_accuracy, ROUND(spec_, 6) AS specificity,
  ROUND(fpr_, 6) AS fpr, ROUND(recall_, 6) AS tpr, ROUND(recall_ - fpr_, 6) AS youden_j,
  ROUND(npv_, 6) AS npv, ROUND((tp + fp) / (tp + fp + tn + fn)::DOUBLE, 6) AS pred_pos_rate"""

BASE = f"WITH {SCORES_SQL}, {curve_sql()}"
SWEPT = f"{BASE}, {SWEEP_SQL}"
PICKED = f"{SWEPT}, {PICKS_SQL}"
BY_MODEL = f"{PICKED}, {_confusion_sql('model')}"
BY_FOLD = f"{PICKED}, {_confusion_sql('model, fold_id')}"
RANKED = f"""{BASE}, ranking AS (
    SELECT model, ({AUC})::DOUBLE AS auc, ({AP})::DOUBLE AS ap FROM curve GROUP BY model)"""
FOLDS = f"""WITH {SCORES_SQL}, {curve_sql('model, fold_id')}, by_fold AS (
    SELECT model, fold_id, ({AUC})::DOUBLE AS auc, ({AP})::DOUBLE AS auprc,
           CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(pos) AS BIGINT) AS n_pos
    FROM curve GROUP BY model, fold_id)"""
ROC_UNION = "UNION ALL SELECT model, NULL, 0.0, 0.0{} FROM curve GROUP BY model"


_FOLD_NAMES = {
    "precision": "precision_",
    "recall": "recall_",
    "f1": "f1_",
    "specificity": "spec_",
    "youden_j": "recall_ - fpr_",
    "npv": "npv_",
    "pred_pos_rate": "(tp + fp) / (tp + fp + tn + fn)::DOUBLE",
}
_FOLD_SPREAD = ", ".join(
    f"ROUND(AVG({e}), 6) AS {n}_mean, ROUND(STDDEV_SAMP({e}), 6) AS {n}_sd"
    for n, e in _FOLD_NAMES.items()
)


def _fold_threshold_summary_sql() -> str:
    return f"{BY_FOLD} SELECT model, threshold_name, {_FOLD_SPREAD} FROM rates GROUP BY model, threshold_name"


def _model_reports_sql() -> str:
    ranking = ", ".join(
        f"ROUND({f}({m}), 6) AS {m}_{part}"
        for m in ("auc", "auprc")
        for f, part in (("AVG", "mean"), ("STDDEV_SAMP", "sd"), ("STDDEV_POP", "sd_pop"))
    )
    return f"""{BY_FOLD}, {curve_sql('model, fold_id', name='fold_curve')}, by_fold AS (
        SELECT model, fold_id, ({AUC})::DOUBLE AS auc, ({AP})::DOUBLE AS auprc, CAST(SUM(n) AS BIGINT) AS n
        FROM fold_curve GROUP BY model, fold_id),
      ranked AS (SELECT model, CAST(COUNT(*) AS INTEGER) AS n_folds, CAST(SUM(n) AS BIGINT) AS n_in_folds,
        ROUND(ARG_MIN(auc, fold_id), 6) AS first_auc, {ranking} FROM by_fold GROUP BY model),
      spread AS (SELECT model, threshold_name, {_FOLD_SPREAD} FROM rates GROUP BY model, threshold_name),
      totals AS (SELECT model, threshold_name, threshold, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp,
        CAST(SUM(tn) AS BIGINT) AS tn, CAST(SUM(fn) AS BIGINT) AS fn FROM confusion GROUP BY ALL),
      whole AS (SELECT model, ROUND(({AUC})::DOUBLE, 6) AS oof_auc, ROUND(({AP})::DOUBLE, 6) AS oof_auprc
        FROM curve GROUP BY model)
      SELECT * EXCLUDE (threshold), {_finite('threshold', 'threshold')}, tp + fp + tn + fn AS n, tp + fn AS n_pos,
        fp + tn AS n_neg, ROUND((tp + fn) / (tp + fp + tn + fn)::DOUBLE, 6) AS prevalence
      FROM totals JOIN whole USING (model) JOIN ranked USING (model) JOIN spread USING (model, threshold_name)"""


ORACLES = {
    "performance_matrix": f"""{BY_MODEL}, ranking AS (
      SELECT model, ({AUC})::DOUBLE AS auc, ({AP})::DOUBLE AS ap FROM curve GROUP BY model)
      SELECT model, {_finite('threshold', 'threshold')}, ROUND(auc, 6) AS auc, ROUND(ap, 6) AS auprc,
             ROUND(precision_, 6) AS precision, ROUND(recall_, 6) AS recall, ROUND(f1_, 6) AS f1,
             ROUND((recall_ + spec_) / 2, 6) AS balanced_accuracy,
             ROUND((tp + fp) / (tp + fp + tn + fn)::DOUBLE, 6) AS pred_pos_rate, tp, fp, fn, tn
      FROM rates JOIN ranking USING (model) WHERE threshold_name = 'youden_j_opt'""",
    "roc_points": f"""{BASE} SELECT model, ROUND(p, 6) AS threshold, ROUND({FPR}, 6) AS fpr,
      ROUND({REC}, 6) AS tpr FROM curve {ROC_UNION.format('')}""",
    "roc_points_no_collinear": f"""{BASE} SELECT model, ROUND(p, 6) AS threshold,
      ROUND({FPR}, 6) AS fpr, ROUND({REC}, 6) AS tpr FROM curve
      WHERE tp + fp = n OR next_n IS NULL OR pos <> next_pos OR n <> next_n {ROC_UNION.format('')}""",
    "pr_points": f"""{BASE} SELECT model, ROUND(p, 6) AS threshold, ROUND({PREC}, 6) AS precision,
      ROUND({REC}, 6) AS recall FROM curve
      UNION ALL SELECT model, NULL, 1.0, 0.0 FROM curve GROUP BY model""",
    "roc_auc": f"{RANKED} SELECT model, ROUND(auc, 6) AS auc FROM ranking",
    "average_precision": f"{RANKED} SELECT model, ROUND(ap, 6) AS auprc FROM ranking",
    "oof_ranking": f"""{RANKED} SELECT model, ROUND(auc, 6) AS oof_auc, ROUND(ap, 6) AS oof_auprc
      FROM ranking""",
    "fold_ranking": f"""{FOLDS} SELECT model, fold_id, ROUND(auc, 6) AS auc, ROUND(auprc, 6) AS auprc,
      n, n_pos FROM by_fold""",
    "sweep_f1": f"""{SWEPT} SELECT model, ROUND(p, 6) AS threshold, ROUND(prec, 6) AS precision,
      ROUND(rec, 6) AS recall, ROUND(f1, 6) AS f1 FROM sweep""",
    "sweep_youden": f"""{SWEPT} SELECT model, ROUND(p, 6) AS threshold, ROUND(fpr, 6) AS fpr,
      ROUND(rec, 6) AS tpr, ROUND(j, 6) AS youden_j FROM sweep {ROC_UNION.format(', 0.0')}""",
    "sweep_recall": f"""{SWEPT} SELECT model, ROUND(p, 6) AS threshold, ROUND(prec, 6) AS precision,
      ROUND(rec, 6) AS recall, ROUND(f1, 6) AS f1, t AS target_recall, rec >= t AS meets_recall
      FROM sweep, (VALUES (0.90::DOUBLE), (0.85::DOUBLE), (0.80::DOUBLE)) targets(t)""",
    "pick_f1": f"""{PICKED} SELECT model, ROUND(threshold, 6) AS threshold FROM picks
      WHERE threshold_name = 'f1_opt'""",
    "pick_youden": f"""{PICKED} SELECT model, {_finite('threshold', 'threshold')} FROM picks
      WHERE threshold_name = 'youden_j_opt'""",
    "pick_recall": f"""{PICKED} SELECT model, ROUND(threshold, 6) AS threshold FROM picks
      WHERE threshold_name = 'recall_0.90'""",
    "threshold_set": f"""{PICKED} SELECT model, threshold_name,
      {_finite('threshold', 'threshold')} FROM picks""",
    "metrics_at_threshold": f"{BY_MODEL} SELECT model, threshold_name, {METRICS_SELECT} FROM rates",
    "join_thresholds": f"""{PICKED} SELECT model, threshold_name, COUNT(*) AS n
      FROM scores JOIN picks USING (model) GROUP BY model, threshold_name""",
    "oof_threshold_metrics": f"""{BY_MODEL}, ranking AS (
      SELECT model, ({AUC})::DOUBLE AS auc, ({AP})::DOUBLE AS ap FROM curve GROUP BY model)
      SELECT model, threshold_name, {METRICS_SELECT}, ROUND(auc, 6) AS oof_auc,
             ROUND(ap, 6) AS oof_auprc FROM rates JOIN ranking USING (model)""",
    "fold_threshold_metrics": f"""{BY_FOLD} SELECT model, fold_id, threshold_name, {METRICS_SELECT}
      FROM rates""",
    "thresholded_predictions": f"""{PICKED} SELECT model, threshold_name, y_true,
      CASE WHEN p >= threshold THEN 1 ELSE 0 END AS y_pred, COUNT(*) AS n
      FROM scores JOIN picks USING (model) GROUP BY ALL""",
    "fold_summary": f"""{FOLDS} SELECT model, ROUND(AVG(auc), 6) AS auc_mean,
      ROUND(STDDEV_SAMP(auc), 6) AS auc_sd, ROUND(AVG(auprc), 6) AS auprc_mean,
      ROUND(STDDEV_SAMP(auprc), 6) AS auprc_sd, ROUND(STDDEV_POP(auc), 6) AS auc_sd_pop,
      ROUND(STDDEV_POP(auprc), 6) AS auprc_sd_pop FROM by_fold GROUP BY model""",
    "model_reports": _model_reports_sql(),
    "fold_threshold_summary": _fold_threshold_summary_sql(),
    "cohort_summary": f"""WITH {SCORES_SQL} SELECT COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS n_pos,
      CAST(SUM(1 - y_true) AS BIGINT) AS n_neg, ROUND(AVG(y_true), 6) AS prevalence FROM lines""",
    "rank_models": f"""{RANKED}, brier AS (
      SELECT model, AVG(POWER(p - y_true, 2)) AS b FROM scores GROUP BY model)
      SELECT 'auc' AS metric, model, ROUND(auc, 8) AS value, RANK() OVER (ORDER BY auc DESC) AS position FROM ranking
      UNION ALL SELECT 'auprc', model, ROUND(ap, 8), RANK() OVER (ORDER BY ap DESC) FROM ranking
      UNION ALL SELECT 'brier', model, ROUND(b, 8), RANK() OVER (ORDER BY b) FROM brier""",
    "brier_score": f"""WITH {SCORES_SQL} SELECT model,
      ROUND(AVG(POWER(LEAST(GREATEST(p, 0), 1) - y_true, 2)), 8) AS brier, COUNT(*) AS n,
      CAST(SUM(y_true) AS BIGINT) AS n_pos, ROUND(AVG(y_true), 8) AS prevalence FROM scores GROUP BY model""",
    "reliability_curve": f"""WITH {SCORES_SQL}, ranked AS (
      SELECT model, p, ROW_NUMBER() OVER (PARTITION BY model ORDER BY p) - 1 AS r,
             COUNT(*) OVER (PARTITION BY model) AS total FROM scores),
      sizes AS (SELECT model, COUNT(*) AS total FROM scores GROUP BY model),
      ks AS (SELECT model, k, (k * (total - 1)) // 10 AS lo_rank, (k * (total - 1)) % 10 AS rest
             FROM sizes, range(1, 10) t(k)),
      edges AS (
        SELECT ks.model, k, a.p + (b.p - a.p) * (rest / 10.0::DOUBLE) AS edge FROM ks
        JOIN ranked a ON a.model = ks.model AND a.r = lo_rank
        JOIN ranked b ON b.model = ks.model AND b.r = lo_rank + CASE WHEN rest > 0 THEN 1 ELSE 0 END),
      lists AS (SELECT model, LIST(edge) AS edges FROM edges GROUP BY model),
      binned AS (SELECT s.model, p, y_true, CAST(LEN(LIST_FILTER(edges, lambda e: e < p)) AS INTEGER) AS bin
                 FROM scores s JOIN lists USING (model))
      SELECT model, bin, ROUND(AVG(p), 6) AS mean_p, ROUND(AVG(y_true), 6) AS positive_rate, COUNT(*) AS n
      FROM binned GROUP BY model, bin""",
}
ORACLES["thresholded_predictions_wide"] = ORACLES["thresholded_predictions"]
