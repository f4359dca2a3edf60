"""Model fitting over documents: search, nested runs, fusion, calibration, scoring, attribution.

The runs search two draws in 3 x 2 folds over small forests, on all rows; ``CFG`` and
``SPACE`` are their size. A fit has no SQL, but its structure has: the ``*_rows`` queries show
which subject, fold, label and model a run scored, and whether with a probability. One evaluation and one set
of final models per session and data folder serve all queries that show a part of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions import scalars
from riskfold.functions.scaling import shared_dir, written
from riskfold.operators import attribution, calibration, cohort, curves, models
from riskfold.operators import summaries, thresholds
from riskfold.plans import evaluation, multi_source, reporting, scoring, single_source
from riskfold.sources import artifacts, tables
from workloads.cohorts import LABELS_SQL, frames, labels, phenotype
from workloads.lines import SCORES_SQL, scores, tidy, wide_scores

SPACE = {
    "trees": range(4, 9),
    "depth": range(2, 5),
    "min_split": range(2, 8),
    "min_leaf": range(2, 6),
    "features": ("sqrt", "0.5", "0.7"),
    "subsample": (0.60, 0.95),
}
CFG = models.SearchConfig(
    outer_folds=3, inner_folds=2, draws=2, seed=42, space=SPACE, parallelism=8
)
CALIBRATION_FOLDS = 2
_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, what: str, make):
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def cohorts_of(spark, sf) -> multi_source.Cohorts:
    return _once(
        spark, sf, "cohorts",
        lambda: multi_source.build_cohorts(frames(spark, sf), labels(spark, sf), CFG),
    )


def stage_of(spark, sf, stage: str) -> multi_source.Run:
    return _once(
        spark, sf, f"stage-{stage}",
        lambda: multi_source.evaluate(
            cohorts_of(spark, sf), CFG, "sigmoid", CALIBRATION_FOLDS, (stage,)
        ),
    )


def run_of(spark, sf) -> multi_source.Run:
    """The whole evaluation, put together from its three stages."""
    cohorts_of(spark, sf)  # once, before the stages share it
    stages = [(lambda s=s: stage_of(spark, sf, s)) for s in ("late", "early", "single")]
    late, early, single = models.in_parallel(spark, stages, len(stages))
    oof = models.union_all([single.oof, early.oof, late.oof])
    forests = {**single.forests, **early.forests}
    return multi_source.Run(oof, late.meta_rows, late.metas, forests)


def single_of(spark, sf) -> single_source.SingleRun:
    return _once(
        spark, sf, "single",
        lambda: single_source.evaluate(
            frames(spark, sf)["text"], labels(spark, sf), CFG, "sigmoid", CALIBRATION_FOLDS
        ),
    )


def isotonic_of(spark, sf) -> multi_source.Run:
    """Early fusion calibrated by monotone maps."""
    return _once(
        spark, sf, "isotonic",
        lambda: multi_source.evaluate(
            cohorts_of(spark, sf), CFG, "isotonic", CALIBRATION_FOLDS, ("early",)
        ),
    )


def final_of(spark, sf) -> multi_source.FinalModels:
    """The final models and their calibrators."""

    def make():
        both = [lambda: multi_source.fit_final(cohorts_of(spark, sf), CFG), lambda: run_of(spark, sf)]
        cohorts_of(spark, sf)  # once, before both read it
        final, run = models.in_parallel(spark, both, len(both))
        return multi_source.add_oof_calibrators(final, run.oof)

    return _once(spark, sf, "final", make)


def saved_of(spark, sf) -> str:
    """Folder the final models were saved to."""
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    return _once(spark, sf, "saved", lambda: artifacts.save_models(final_of(spark, sf), path))


def loaded_of(spark, sf) -> multi_source.FinalModels:
    return _once(
        spark, sf, "loaded",
        lambda: artifacts.load_models(spark, saved_of(spark, sf), ["meta", "text", "vector"]),
    )


def forest_of(spark, sf) -> models.FittedForest:
    """One forest on the text columns of every labelled document."""

    def make():
        df = cohort.join_label(frames(spark, sf)["text"], labels(spark, sf))
        columns = [c for c in df.columns if c not in (cohort.ID, cohort.LABEL)]
        return models.fit_forest(df, columns, models.ForestParams(8, 4, 2, 2), 42)

    return _once(spark, sf, "forest", make)


def new_subjects(spark, sf) -> DataFrame:
    """Documents in every source that have no label."""
    pheno = phenotype(spark, sf).select(
        scalars.normalize_id(F.col("subject_id")).alias(cohort.ID), F.col("toxic").alias(cohort.LABEL)
    )
    return scoring.scoring_cohort(pheno, frames(spark, sf), unlabelled_only=True)


def oof_of(spark, sf, stage: str, prefix: str) -> DataFrame:
    return tidy(stage_of(spark, sf, stage).oof.filter(F.col("model").startswith(prefix)))


def _calibrated(spark, sf):
    both = [oof_of(spark, sf, "early", "multi_early_cal"), oof_of(spark, sf, "late", "multi_late_cal")]
    return models.union_all(both)


# ---------------------------------------------------------------- queries


def _train_forest(spark, sf):
    m = forest_of(spark, sf)
    rows = list(zip(m.names, [float(x) for x in m.model.featureImportances.toArray()]))
    importance = spark.createDataFrame(rows, "feature string, importance double")
    return tidy(importance.withColumn("trees", F.lit(m.model.getNumTrees)))


def _search(spark, sf, space=SPACE, draws=3):
    """Every draw with its inner average precision."""
    df = cohort.join_label(frames(spark, sf)["text"], labels(spark, sf))
    columns = [c for c in df.columns if c not in (cohort.ID, cohort.LABEL)]
    cfg = models.SearchConfig(2, 2, draws, 42, space, 4)
    m = models.fit_tuned(df, columns, cfg)
    rows = [(p.to_json(), float(s), p == m.params) for p, s in m.search]
    return tidy(spark.createDataFrame(rows, "params string, auprc double, chosen boolean"))


def _meta_rows(spark, sf):
    return tidy(models.union_all(list(stage_of(spark, sf, "late").meta_rows.values())))


def _meta_fit(spark, sf):
    """The meta-model of two line scores: an exact fit, so it has an oracle."""
    meta = models.fit_meta(wide_scores(spark, sf), ["disc", "price"], prefix="")
    rows = [*meta.coefficients.items(), ("intercept", meta.intercept)]
    return tidy(spark.createDataFrame(rows, "input string, coefficient double"), 3)


def _metas(spark, sf):
    rows = [
        (fold, name, float(v))
        for fold, m in stage_of(spark, sf, "late").metas.items()
        for name, v in [*m.coefficients.items(), ("intercept", m.intercept)]
    ]
    return tidy(spark.createDataFrame(rows, "fold_id int, input string, coefficient double"))


def _fit_platt(spark, sf):
    """Slope and intercept of the sigmoid map of each line score stream, from one table of counts."""
    s = curves.count_table(scores(spark, sf), ["model"])
    rows = []
    for m in ("disc", "qty", "price"):
        cal = calibration.fit_sigmoid(s.filter(F.col("model") == m))
        rows.append((m, cal.a, cal.b))
    return tidy(spark.createDataFrame(rows, "model string, a double, b double"), 4)


def _final(spark, sf):
    return artifacts.training_columns(spark, saved_of(spark, sf))


def _saved(spark, sf):
    return artifacts.read_manifest(spark, saved_of(spark, sf)).select("name", "kind")


def _loaded(spark, sf):
    """Probabilities of the loaded single-source and early models on the whole intersection."""
    m, wide = loaded_of(spark, sf), cohorts_of(spark, sf).wide
    scored = {**m.singles, "early": m.early}
    return tidy(
        models.union_all(
            [f.predict(wide, [cohort.ID]).withColumn("model", F.lit(n)) for n, f in scored.items()]
        )
    )


def _score_table(spark, sf):
    thr = thresholds.threshold_set(curves.cumulative_curve(run_of(spark, sf).oof))
    return tidy(scoring.score_table(loaded_of(spark, sf), new_subjects(spark, sf), thr))


def _score_calibrated(spark, sf):
    m, df = loaded_of(spark, sf), new_subjects(spark, sf)
    early = scoring.score_early(m, df, df.columns)
    late = scoring.score_late(m, early, [cohort.ID, "risk_multi_early_raw"])
    return tidy(scoring.score_calibrated(m, late))


def _tree_attribution(spark, sf):
    df = cohort.join_label(frames(spark, sf)["text"], labels(spark, sf))
    return tidy(attribution.tree_attribution(forest_of(spark, sf), df))


def _tree_additivity(spark, sf):
    """Labelled documents, and those whose base and contributions miss the probability."""
    fitted, df = forest_of(spark, sf), cohort.join_label(frames(spark, sf)["text"], labels(spark, sf))
    parts = attribution.tree_contributions(fitted, df)
    total = F.aggregate("contributions", F.col("base"), lambda a, v: a + v)
    return parts.join(fitted.predict(df), cohort.ID).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~(F.abs(total - F.col("p")) <= 1e-9)).alias("n_off"),
    )


def _within(*names: str):
    """1 where every named column is a probability."""
    ok = F.lit(True)
    for n in names:
        ok = ok & F.coalesce(F.col(n).between(0, 1), F.lit(False))
    return ok.cast("int").alias("ok")


def _rows(oof: DataFrame) -> DataFrame:
    return oof.select(cohort.ID, "fold_id", cohort.LABEL, "model", _within("p"))


def _inner_rows(spark, sf):
    """Meta-training rows under each outer fold."""
    parts = stage_of(spark, sf, "late").meta_rows
    names = [f"p_{n}" for n in cohorts_of(spark, sf).names]
    return models.union_all(
        d.select(F.lit(k).alias("outer_fold"), cohort.ID, "fold_id", cohort.LABEL, _within(*names))
        for k, d in parts.items()
    )


def _loaded_equal(spark, sf):
    """Rows of the intersection, and those a loaded model scores unlike the one in memory."""
    kept, read, wide = final_of(spark, sf), loaded_of(spark, sf), cohorts_of(spark, sf).wide
    pairs = {n: (m, read.singles[n]) for n, m in kept.singles.items()} | {
        "early": (kept.early, read.early)
    }
    parts = []
    for name, (a, b) in pairs.items():
        both = a.predict(wide, name="p").join(b.predict(wide, name="q"), cohort.ID)
        off = F.count_if(~F.coalesce(F.abs(F.col("p") - F.col("q")) <= 1e-12, F.lit(False)))
        parts.append(
            both.agg(F.count(F.lit(1)).alias("n"), off.alias("n_off")).withColumn("model", F.lit(name))
        )
    return models.union_all(parts)


def _calibrator_metadata(spark, sf):
    """What the saved folder says about the rows each map was fitted on."""
    rows = [{"model": k, **m} for k, m in loaded_of(spark, sf).calibrator_meta.items()]
    schema = "model string, method string, clip double, n_oof long, n_pos long, prevalence double"
    return tidy(spark.createDataFrame(rows, schema))


def _scored_rows(spark, sf):
    """Every new subject, and whether all its risks are probabilities."""
    out = _score_calibrated(spark, sf)
    risks = [c for c in out.columns if c.startswith("risk_")]
    return out.select(cohort.ID, F.lit(len(risks)).alias("n_risks"), _within(*risks))


def fold_attribution_of(spark, sf) -> DataFrame:
    """Attribution of every fold's models on all their training rows."""
    return _once(
        spark, sf, "attribution",
        lambda: written(
            multi_source.fold_attribution(run_of(spark, sf), cohorts_of(spark, sf), CFG), "attribution"
        ),
    )


def _attribution_features(spark, sf):
    """Features of the models, in how many folds, and whether the mean is that of the folds."""
    folds = fold_attribution_of(spark, sf)
    mean = multi_source.mean_attribution(folds, CFG)
    each = folds.groupBy("model", "feature").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.min((F.col("mean_abs") >= F.abs("mean_signed") - 1e-12).cast("int")).alias("bounded"),
        F.avg("mean_abs").alias("expected"),
    )
    same = (F.abs(F.col("expected") - F.col("mean_abs")) <= 1e-9).cast("int")
    known = F.col("model").isin("single_text", "single_vector", multi_source.META)
    return each.join(mean, ["model", "feature"]).filter(known).select(
        "model", "feature", "n_folds", "bounded", same.alias("averaged")
    )


def _linear_meta(spark, sf):
    """Attribution of the meta-model inputs, averaged over outer folds."""
    run = stage_of(spark, sf, "late")
    parts = []
    for fold, m in run.metas.items():
        named = {f"p_{n}": c for n, c in m.coefficients.items()}
        part = attribution.linear_attribution(run.meta_rows[fold], named)
        parts.append(part.withColumn("fold_id", F.lit(fold)))
    mean = attribution.average_attribution(models.union_all(parts), len(parts))
    return tidy(mean.withColumn("feature", scalars.meta_feature_name(F.col("feature"))))


def _report(spark, sf):
    """The report of the whole run, written and read back: size, folds and parameters by model."""
    run, path = run_of(spark, sf), f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    saved = {r.name: r.kind for r in artifacts.read_manifest(spark, saved_of(spark, sf)).collect()}
    report = reporting.run_report(
        run.oof, CFG, cohorts_of(spark, sf).names, reporting.chosen_parameters(run),
        "sigmoid", CALIBRATION_FOLDS, saved,
    )
    tables.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select(
        F.col("run_info.n_subjects").alias("n_subjects"),
        F.col("run_info.outer_folds").alias("outer_folds"),
        F.size("saved_models").alias("n_saved"),
        F.explode("models").alias("model", "m"),
    ).select(
        "n_subjects", "outer_folds", "n_saved", "model", "m.n", "m.n_pos",
        F.transform("m.folds", lambda f: f["n"]).alias("fold_sizes"),
        F.size("m.params").alias("n_params"), F.size("m.thresholds").alias("n_thresholds"),
    ).withColumn("fold_sizes", F.array_join("fold_sizes", ","))


def _params(spark, sf):
    """Parameters most outer folds of the single-source run chose."""
    return summaries.modal_best_params(single_of(spark, sf).best)


QUERIES = {
    "train_forest": _train_forest,
    "predict_probability": lambda s, d: tidy(forest_of(s, d).predict(frames(s, d)["text"])),
    "search_best_model": _search,
    "search_multi_space": lambda s, d: _search(s, d, models.MULTI_SPACE, 2),
    "search_single_space": lambda s, d: _search(s, d, models.SINGLE_SPACE, 2),
    "single_source_baseline": lambda s, d: oof_of(s, d, "single", "single_"),
    "single_source_nested_cv": lambda s, d: tidy(single_of(s, d).oof),
    "single_source_params": _params,
    "run_report": _report,
    "early_fusion_cv": lambda s, d: oof_of(s, d, "early", "multi_early"),
    "late_fusion_inner_oof": _meta_rows,
    "late_fusion_base_test": lambda s, d: oof_of(s, d, "late", "base_"),
    "late_fusion_cv": lambda s, d: oof_of(s, d, "late", "multi_late"),
    "train_meta_logistic": _meta_fit,
    "late_fusion_meta_models": _metas,
    "calibrate_cv": _calibrated,
    "calibrate_cv_isotonic": lambda s, d: tidy(
        isotonic_of(s, d).oof.filter("model = 'multi_early_cal'")
    ),
    "run_performance_matrix": lambda s, d: tidy(thresholds.performance_matrix(run_of(s, d).oof)),
    "run_evaluation_tables": lambda s, d: tidy(evaluation.curve_table(run_of(s, d).oof)),
    "fit_platt": _fit_platt,
    "final_models": _final,
    "save_models": _saved,
    "load_models": _loaded,
    "score_early": lambda s, d: tidy(
        scoring.score_early(loaded_of(s, d), new_subjects(s, d), [cohort.ID])
    ),
    "score_late": lambda s, d: tidy(
        scoring.score_late(loaded_of(s, d), new_subjects(s, d), [cohort.ID])
    ),
    "score_calibrated": _score_calibrated,
    "score_table": _score_table,
    "tree_attribution": _tree_attribution,
    "tree_attribution_additivity": _tree_additivity,
    "single_source_baseline_rows": lambda s, d: _rows(oof_of(s, d, "single", "single_")),
    "single_source_nested_cv_rows": lambda s, d: _rows(single_of(s, d).oof),
    "early_fusion_cv_rows": lambda s, d: _rows(oof_of(s, d, "early", "multi_early")),
    "late_fusion_inner_oof_rows": _inner_rows,
    "late_fusion_base_test_rows": lambda s, d: _rows(oof_of(s, d, "late", "base_")),
    "late_fusion_cv_rows": lambda s, d: _rows(oof_of(s, d, "late", "multi_late")),
    "calibrate_cv_rows": lambda s, d: _rows(_calibrated(s, d)),
    "calibrate_cv_isotonic_rows": lambda s, d: _rows(
        isotonic_of(s, d).oof.filter("model = 'multi_early_cal'")
    ),
    "calibrator_metadata": _calibrator_metadata,
    "load_models_equal": _loaded_equal,
    "score_calibrated_rows": _scored_rows,
    "linear_attribution_meta": _linear_meta,
    "run_fold_attribution": lambda s, d: tidy(fold_attribution_of(s, d)),
    "run_attribution": lambda s, d: tidy(
        multi_source.mean_attribution(fold_attribution_of(s, d), CFG)
    ),
    "run_attribution_features": _attribution_features,
}

INTERSECTION_SQL = """
  met AS (
    SELECT subject_id, y_true FROM labelled WHERE subject_id IN (
      SELECT CAST(vec_id AS VARCHAR) FROM embeddings))"""


def _run_sql(cohort_name: str, names: list[str]) -> str:
    """Subjects with their outer fold, once per model."""
    return f"""WITH {LABELS_SQL}, {INTERSECTION_SQL}, folds AS (
        SELECT subject_id, y_true, CAST((ROW_NUMBER() OVER (
                 ORDER BY y_true, MD5('{CFG.seed}|' || subject_id), subject_id) - 1)
                 % {CFG.outer_folds} + 1 AS INTEGER) AS fold_id FROM {cohort_name})
      SELECT subject_id, fold_id, y_true, model, 1 AS ok
      FROM folds, (VALUES {", ".join(f"('{n}')" for n in names)}) m(model)"""


_SOURCES = ("meta", "text", "vector")
_BASES = [f"base_{n}" for n in _SOURCES]
_EARLY, _LATE = ["multi_early", "multi_early_cal"], ["multi_late", "multi_late_cal"]

_G = ("gd", "gp", "gb")
_H = (("hdd", "hdp", "hdb"), ("hdp", "hpp", "hpb"), ("hdb", "hpb", "hbb"))


def _det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer(k: int) -> str:
    """Component ``k`` of the Newton step."""
    swapped = [[_G[r] if c == k else _H[r][c] for c in range(3)] for r in range(3)]
    return f"{_det(swapped)} / {_det(_H)}"


def _meta_sql() -> str:
    """Newton steps on half the squared norm, intercept included, plus weighted log-loss."""
    moments = ", ".join(
        f"{1 if a == b else 0} + SUM(w * q * (1 - q) * {xa} * {xb}) AS h{a}{b}"
        for a, xa, b, xb in (
            ("d", "disc", "d", "disc"), ("d", "disc", "p", "price"), ("d", "disc", "b", "1"),
            ("p", "price", "p", "price"), ("p", "price", "b", "1"), ("b", "1", "b", "1"),
        )
    )
    return f"""WITH RECURSIVE {SCORES_SQL}, sizes AS (
        SELECT COUNT(*)::DOUBLE AS total, SUM(y_true)::DOUBLE AS pos FROM lines),
      rows_ AS (SELECT disc, price, y_true, CASE WHEN y_true = 1 THEN total / (2 * pos)
                ELSE total / (2 * (total - pos)) END AS w FROM lines, sizes),
      steps(k, d, p, b) AS (
        SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
        UNION ALL
        SELECT k + 1, d - {_cramer(0)}, p - {_cramer(1)}, b - {_cramer(2)} FROM (
          SELECT k, d, p, b, d + SUM(w * (q - y_true) * disc) AS gd, p + SUM(w * (q - y_true) * price) AS gp,
                 b + SUM(w * (q - y_true)) AS gb, {moments}
          FROM (SELECT k, d, p, b, disc, price, y_true, w, 1 / (1 + EXP(-(d * disc + p * price + b))) AS q
                FROM steps, rows_ WHERE k < 12) s GROUP BY k, d, p, b))
      SELECT 'disc' AS input, ROUND(d, 3) AS coefficient FROM steps WHERE k = 12
      UNION ALL SELECT 'price', ROUND(p, 3) FROM steps WHERE k = 12
      UNION ALL SELECT 'intercept', ROUND(b, 3) FROM steps WHERE k = 12"""


ORACLES = {
    "run_report": f"""WITH one AS ({_run_sql("met", [*(f"single_{n}" for n in _SOURCES), *_BASES, *_EARLY, *_LATE])}),
      sizes AS (SELECT model, fold_id, COUNT(*) AS n, SUM(y_true) AS pos FROM one GROUP BY model, fold_id)
      SELECT CAST(SUM(n) AS BIGINT) AS n_subjects, {CFG.outer_folds} AS outer_folds, 10 AS n_saved, model,
        CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(pos) AS BIGINT) AS n_pos, STRING_AGG(n, ',' ORDER BY fold_id) AS fold_sizes,
        CASE WHEN model LIKE 'single%' OR model = 'multi_early' THEN {CFG.outer_folds} ELSE 0 END AS n_params,
        6 AS n_thresholds FROM sizes GROUP BY model""",
    "tree_attribution_additivity": f"""WITH {LABELS_SQL}
      SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS n_off FROM labelled""",
    "run_attribution_features": f"""SELECT model, feature, {CFG.outer_folds}::BIGINT AS n_folds, 1 AS bounded, 1 AS averaged
      FROM (VALUES ('single_text', 'n_chars'), ('single_text', 'n_len'), ('single_text', 'n_digits'),
        ('single_text', 'n_lines'), ('single_text', 'n_spaces'), ('{multi_source.META}', 'Meta'),
        ('{multi_source.META}', 'Text'), ('{multi_source.META}', 'Vector')) t(model, feature)
      UNION ALL SELECT 'single_vector', 'v:' || i, {CFG.outer_folds}, 1, 1 FROM range(0, 64) r(i)""",
    "single_source_baseline_rows": _run_sql("met", [f"single_{n}" for n in _SOURCES]),
    "single_source_nested_cv_rows": _run_sql("labelled", ["uncalibrated", "calibrated"]),
    "early_fusion_cv_rows": _run_sql("met", _EARLY),
    "late_fusion_inner_oof_rows": f"""SELECT outer_fold, subject_id, fold_id, y_true, ok
      FROM ({_run_sql("met", ["any"])}), (SELECT CAST(k AS INTEGER) AS outer_fold
        FROM range(1, {CFG.outer_folds + 1}) r(k)) WHERE fold_id <> outer_fold""",
    "late_fusion_base_test_rows": _run_sql("met", _BASES),
    "late_fusion_cv_rows": _run_sql("met", _LATE),
    "calibrate_cv_rows": _run_sql("met", [_EARLY[1], _LATE[1]]),
    "calibrate_cv_isotonic_rows": _run_sql("met", [_EARLY[1]]),
    "calibrator_metadata": f"""WITH {LABELS_SQL}, {INTERSECTION_SQL}
      SELECT model, 'sigmoid' AS method, CAST(0.000001 AS DOUBLE) AS clip, COUNT(*) AS n_oof, CAST(SUM(y_true) AS BIGINT) AS n_pos,
             ROUND(AVG(y_true), 6) AS prevalence FROM met, (VALUES ('early'), ('late')) m(model) GROUP BY model""",
    "load_models_equal": f"""WITH {LABELS_SQL}, {INTERSECTION_SQL}
      SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS n_off, model
      FROM met, (VALUES ('meta'), ('text'), ('vector'), ('early')) m(model) GROUP BY model""",
    "score_calibrated_rows": """SELECT CAST(d.doc_id AS VARCHAR) AS subject_id, 4 AS n_risks, 1 AS ok
      FROM documents d LEFT JOIN labels l USING (doc_id)
      WHERE l.toxic IS NULL AND d.doc_id IN (SELECT vec_id FROM embeddings)""",
    "train_meta_logistic": _meta_sql(),
    # Newton steps on half the squared slope plus log-loss, from zero.
    "fit_platt": f"""WITH RECURSIVE {SCORES_SQL}, g AS (
        SELECT model, p AS x, SUM(y_true)::DOUBLE AS pos, COUNT(*)::DOUBLE AS n FROM scores GROUP BY model, p),
      steps(model, k, a, b) AS (
        SELECT model, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM g GROUP BY model
        UNION ALL
        SELECT model, k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
               b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
        FROM (
          SELECT s.model, k, a, b, a + SUM((n * q - pos) * x) AS ga, SUM(n * q - pos) AS gb,
                 1 + SUM(n * q * (1 - q) * x * x) AS haa, SUM(n * q * (1 - q) * x) AS hab,
                 SUM(n * q * (1 - q)) AS hbb
          FROM (SELECT s.model, k, a, b, x, pos, n, 1 / (1 + EXP(-(a * x + b))) AS q
                FROM steps s JOIN g ON g.model = s.model WHERE k < 12) s
          GROUP BY s.model, k, a, b))
      SELECT model, ROUND(a, 4) AS a, ROUND(b, 4) AS b FROM steps WHERE k = 12""",
}
