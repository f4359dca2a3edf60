"""Whole plans checked by value: scoring, evaluation tables and attribution with given scores and
coefficients, and fitted models held against their own node tables or optimality conditions.

Given scores are columns of ``lineitem``, so every probability, flag and display id has plain SQL.
What is fitted has none, but a forest's probability is a walk down its saved nodes, and a fit of
a convex loss is right exactly where the gradient vanishes: those queries count the rows or
parameters that miss.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import col
from riskfold.operators import attribution, calibration, cohort, models, treepaths
from riskfold.plans import evaluation, multi_source, scoring, single_source
from workloads.cohorts import COEFS, LABELS_SQL, frames
from workloads.cohorts import ORACLES as COHORT_ORACLES
from workloads.lines import AP, AUC, FPR, PREC, REC, ROC_UNION, SCORES_SQL, curve_sql, table, tidy
from workloads.lines import ORACLES as LINE_ORACLES
from workloads.lines import wide_scores
from workloads.modelling import CALIBRATION_FOLDS, CFG, INTERSECTION_SQL, SPACE
from workloads.modelling import cohorts_of, forest_of, labels, single_of, stage_of

# ---------------------------------------------------------------- scoring with given scores

META = models.MetaModel({"disc": 1.5, "price": -0.75}, 0.25)
EARLY = calibration.Sigmoid(2.5, -1.25)
LATE = calibration.Sigmoid(0.8, 0.1, logit=True, clip=1e-6)
RULES = [
    ("multi_early", "fixed", 0.5),
    ("multi_early_cal", "recall_0.90", 0.3),
    ("multi_late", "youden_j_opt", 0.62),
    ("multi_late_cal", "f1_opt", 0.6),
    ("multi_late_cal", "never", float("inf")),
]


@dataclass(frozen=True)
class GivenScore:
    """A model whose probability is a column."""

    column: str

    def predict(self, df: DataFrame, keep: Sequence[str] = (cohort.ID,), name: str = "p") -> DataFrame:
        return df.select(*[col(k) for k in keep], col(self.column).alias(name))


def given_models() -> multi_source.FinalModels:
    bases = {n: GivenScore(n) for n in META.coefficients}
    return multi_source.FinalModels({}, GivenScore("qty"), bases, META, {"early": EARLY, "late": LATE})


def lines_to_score(spark, sf) -> DataFrame:
    """Every line under its own id; lines that were returned lack one score."""
    keys = F.concat_ws("-", "l_orderkey", "l_linenumber").alias(cohort.ID)
    return table(spark, sf, "lineitem").select(
        keys,
        (F.col("l_returnflag") == "R").cast("int").alias(cohort.LABEL),
        (F.col("l_discount") * 10).alias("disc"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50).alias("qty"),
        (F.col("l_extendedprice") / 105000).alias("price"),
    )


def _score_table(spark, sf):
    rules = spark.createDataFrame(RULES, "model string, threshold_name string, threshold double")
    out = scoring.score_table(given_models(), lines_to_score(spark, sf), rules)
    return tidy(out.toDF(*[c.replace(".", "_") for c in out.columns]))


def _score_early(spark, sf):
    return tidy(scoring.score_early(given_models(), lines_to_score(spark, sf), [cohort.ID]))


def _score_late(spark, sf):
    return tidy(scoring.score_late(given_models(), lines_to_score(spark, sf), [cohort.ID]))


# ---------------------------------------------------------------- evaluation tables of given streams

# Score of each stream, in the SQL of both engines.
STREAMS = {
    "multi_late": "price",
    "multi_early": "qty",
    "single_serology": "disc",
    "single_lab": "1 - qty",
    "single_clinical": "(price + qty) / 2",
    "single_genetics": "1 - disc",
    "multi_late_cal": "price * price",
    "multi_early_cal": "qty * qty",
}


def wide_oof(spark, sf) -> DataFrame:
    """The wide out-of-fold table of the streams."""
    return wide_scores(spark, sf).select(
        "fold_id", "y_true", *[F.expr(e).alias(f"proba_{m}") for m, e in STREAMS.items()]
    )


def evaluation_of(spark, sf) -> evaluation.EvaluationTables:
    return evaluation.evaluation_tables(evaluation.unified_stream(wide_oof(spark, sf)))


def _reliability(spark, sf):
    tables = evaluation_of(spark, sf)
    return tidy(tables.reliability.unionByName(tables.reliability_cal))


def _brier(spark, sf):
    tables = evaluation_of(spark, sf)
    return tidy(tables.brier.unionByName(tables.brier_cal), 8)


def _importance(spark, sf):
    """Inputs of a meta-model under their sources' names, largest first."""
    scores = wide_scores(spark, sf).select(*[F.col(n).alias(f"p_{n}") for n in COEFS])
    given = {f"p_{n}": c for n, c in COEFS.items()}
    found = attribution.linear_attribution(scores, given, correlated=False)
    return tidy(evaluation.late_importance(found).select("feature", "mean_abs"))


def _signed(spark, sf):
    return tidy(attribution.linear_attribution(wide_scores(spark, sf), COEFS, correlated=False))


# ---------------------------------------------------------------- fitted models


def walked(tree: treepaths.Tree, x: Column, depth: int) -> Column:
    """Probability at the leaf that ``x`` reaches."""
    nodes = F.array(
        *[
            F.struct(
                F.lit(int(a)).alias("left"),
                F.lit(int(b)).alias("right"),
                F.lit(int(s)).alias("slot"),
                F.lit(float(t)).alias("threshold"),
                F.lit(float(v)).alias("value"),
            )
            for a, b, s, t, v in zip(tree.left, tree.right, tree.slot, tree.threshold, tree.value)
        ]
    )

    def step(at: Column, _: Column) -> Column:
        node = nodes[at]
        down = F.when(x[node["slot"]] <= node["threshold"], node["left"]).otherwise(node["right"])
        return F.when(node["left"] < 0, at).otherwise(down)

    return nodes[F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)]["value"]


def _walk(spark, sf):
    """Documents, and those whose probability is not the mean over leaves reached in the node tables."""
    fitted, df = forest_of(spark, sf), frames(spark, sf)["text"]
    trees = list(treepaths.forest_trees(fitted.model, spark))
    x = vector_to_array("features")
    total = sum((walked(t, x, fitted.params.depth) for t in trees), F.lit(0.0))
    plain = fitted.vectors(df).select(cohort.ID, (total / len(trees)).alias("q"))
    off = ~F.coalesce(F.abs(F.col("p") - F.col("q")) <= 1e-9, F.lit(False))
    return fitted.predict(df).join(plain, cohort.ID).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(off).alias("n_off")
    )


def _search_choice(spark, sf):
    """Draws of a search, and whether the first of the best was refitted."""
    df = cohort.join_label(frames(spark, sf)["text"], labels(spark, sf))
    columns = [c for c in df.columns if c not in (cohort.ID, cohort.LABEL)]
    cfg = models.SearchConfig(2, 2, 3, 42, SPACE, 4)
    fitted = models.fit_tuned(df, columns, cfg)
    best = max(range(len(fitted.search)), key=lambda i: (fitted.search[i][1], -i))
    in_space = all(
        p.trees in SPACE["trees"] and p.depth in SPACE["depth"] and 0 < s <= 1 for p, s in fitted.search
    )
    row = (df.count(), len(fitted.search), fitted.search[best][0] == fitted.params, in_space)
    return spark.createDataFrame([row], "n long, n_draws int, best_chosen boolean, in_space boolean")


def _off(gradient: Column, n: Column) -> Column:
    """1 where a gradient has not vanished against the number of rows."""
    return F.when(F.abs(gradient) <= 1e-5 * n, 0).otherwise(1)


def _meta_optimal(spark, sf):
    """Meta-training rows by outer fold, and parameters at which the penalized loss still falls."""
    run, names, parts = stage_of(spark, sf, "late"), cohorts_of(spark, sf).names, []
    for fold, m in run.metas.items():
        y = F.col(cohort.LABEL)
        rows = run.meta_rows[fold]
        n, pos = rows.agg(F.count(F.lit(1)), F.sum(y)).first()
        miss = F.when(y == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) * (m.probability() - y)
        slopes = [m.coefficients[n] + F.sum(miss * F.col(f"p_{n}")) for n in names]
        slopes.append(m.intercept + F.sum(miss))
        total = sum((_off(g, F.count(F.lit(1))) for g in slopes), F.lit(0))
        parts.append(rows.agg(F.count(F.lit(1)).alias("n"), total.alias("n_off")).withColumn("fold_id", F.lit(fold)))
    return models.union_all(parts)


def _single_calibrators(spark, sf):
    """Rows of each single-source stream, and parameters of its map at which the loss still falls."""
    run, parts = single_of(spark, sf), []
    for stream, cal in single_source.oof_calibrators(run).items():
        rows = run.oof.filter(F.col("model") == stream)
        x = calibration.sigmoid_input(F.col("p"), cal.logit, cal.clip)
        miss, n = cal.apply(F.col("p")) - F.col(cohort.LABEL), F.count(F.lit(1))
        total = _off(cal.a + F.sum(miss * x), n) + _off(F.sum(miss), n)
        parts.append(rows.agg(n.alias("n"), total.alias("n_off")).withColumn("model", F.lit(stream)))
    return models.union_all(parts)


def _deployable(spark, sf):
    """Every document under the model refitted for use, plain and calibrated."""
    model, cal = single_source.fit_deployable(single_of(spark, sf), CFG, "sigmoid", CALIBRATION_FOLDS)
    df = frames(spark, sf)["text"]
    both = [
        m.predict(df, [cohort.ID]).withColumn("model", F.lit(n))
        for n, m in ((single_source.RAW, model), (single_source.CALIBRATED, cal))
    ]
    ok = F.coalesce(F.col("p").between(0, 1), F.lit(False)).cast("int").alias("ok")
    return models.union_all(both).select(cohort.ID, "model", ok)


QUERIES = {
    "score_table_given": _score_table,
    "score_early_given": _score_early,
    "score_late_given": _score_late,
    "evaluation_ranking": lambda s, d: tidy(evaluation_of(s, d).ranking),
    "evaluation_roc": lambda s, d: tidy(evaluation_of(s, d).roc),
    "evaluation_pr": lambda s, d: tidy(evaluation_of(s, d).pr),
    "evaluation_reliability": _reliability,
    "evaluation_brier": _brier,
    "late_importance": _importance,
    "linear_attribution_signed": _signed,
    "predict_probability_walk": _walk,
    "search_choice": _search_choice,
    "late_fusion_meta_optimal": _meta_optimal,
    "single_source_calibrators": _single_calibrators,
    "single_source_deployable": _deployable,
}

# ---------------------------------------------------------------- oracles


def _scored_sql() -> str:
    margin = " + ".join([str(META.intercept), *(f"{c} * {n}" for n, c in META.coefficients.items())])
    clipped = f"LEAST(GREATEST(late, {LATE.clip}), 1 - {LATE.clip})"
    return f"""WITH lines AS (
        SELECT l_orderkey || '-' || l_linenumber AS subject_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
               l_discount * 10 AS disc, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50 END AS early,
               l_extendedprice / 105000 AS price FROM lineitem),
      raw AS (SELECT *, 1 / (1 + EXP(-({margin})))::DOUBLE AS late, LPAD(subject_id, GREATEST(LENGTH(subject_id), 7)::INTEGER, '0') AS f
              FROM lines),
      scored AS (SELECT *, 1 / (1 + EXP(-({EARLY.a} * early + {EARLY.b})))::DOUBLE AS early_cal,
        1 / (1 + EXP(-({LATE.a} * LN({clipped} / (1 - {clipped})) + {LATE.b})))::DOUBLE AS late_cal FROM raw)"""


def _flag_sql() -> str:
    names = {"multi_early": "early", "multi_early_cal": "early_cal", "multi_late": "late", "multi_late_cal": "late_cal"}
    return ", ".join(
        f"CASE WHEN {names[m]} >= '{t}'::DOUBLE THEN 'Yes' ELSE 'No' END AS "
        + f"binary_{m}_{n}_thr_{t:.2f}".replace(".", "_")
        for m, n, t in RULES
    )


_UNION = " UNION ALL ".join(
    f"SELECT '{m}' AS model, fold_id, y_true, {e} AS p FROM lines" for m, e in STREAMS.items()
)
STREAMS_SQL = f"""{SCORES_SQL.split('scores AS')[0]} scores AS ({_UNION})"""
_MAIN = ", ".join(f"'{m}'" for m in evaluation.REQUIRED)
_FUSED = "'multi_late', 'multi_early', 'multi_late_cal', 'multi_early_cal'"
_CURVES = f"WITH {STREAMS_SQL}, main AS (SELECT * FROM scores WHERE model IN ({_MAIN})), {curve_sql(source='main')}"


def _of_fused(key: str) -> str:
    return f"SELECT * FROM ({LINE_ORACLES[key].replace(SCORES_SQL, STREAMS_SQL)}) WHERE model IN ({_FUSED})"


def _correlated_sql() -> str:
    """Exact split of the conditional expectation of three inputs over their orders of arrival."""
    names, b = list(COEFS), COEFS

    def c(i, j):
        return f"c_{min(i, j)}_{max(i, j)}"

    def known(*have):
        terms = [f"{b[i]} * d_{i}" for i in have]
        for k in (n for n in names if n not in have):
            if len(have) == 1:
                terms.append(f"{b[k]} * {c(k, have[0])} / {c(have[0], have[0])} * d_{have[0]}")
            elif len(have) == 2:
                i, j = have
                det = f"({c(i, i)} * {c(j, j)} - {c(i, j)} * {c(i, j)})"
                terms.append(f"{b[k]} * ({c(k, i)} * {c(j, j)} - {c(k, j)} * {c(i, j)}) / {det} * d_{i}")
                terms.append(f"{b[k]} * ({c(k, j)} * {c(i, i)} - {c(k, i)} * {c(i, j)}) / {det} * d_{j}")
        return "(" + " + ".join(terms) + ")"

    def share(i):
        j, k = (n for n in names if n != i)
        return f"""{known(i)} / 3 + ({known(i, j)} - {known(j)} + {known(i, k)} - {known(k)}) / 6
          + ({known(i, j, k)} - {known(j, k)}) / 3"""

    pairs = {c(i, j): (i, j) for i in names for j in names}
    moments = ", ".join(f"COVAR_SAMP({i}, {j}) AS {n}" for n, (i, j) in pairs.items())
    means = ", ".join(f"AVG({n}) AS m_{n}" for n in names)
    centred = ", ".join(f"{n} - m_{n} AS d_{n}" for n in names)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, {share(n)} AS v FROM centred" for n in names)
    return f"""WITH {SCORES_SQL}, moments AS (SELECT {moments}, {means} FROM lines),
      centred AS (SELECT *, {centred} FROM lines, moments)
      SELECT feature, ROUND(AVG(ABS(v)), 6) AS mean_abs, ROUND(AVG(v), 6) + 0.0 AS mean_signed FROM ({rows}) GROUP BY feature"""


_SCORED = _scored_sql()
_LABELLED = f"WITH {LABELS_SQL}"
ORACLES = {
    "score_table_given": f"""{_SCORED} SELECT subject_id, y_true, ROUND(early, 6) AS risk_multi_early_raw,
      ROUND(late, 6) AS risk_multi_late_raw, ROUND(early_cal, 6) AS risk_multi_early, ROUND(late_cal, 6) AS risk_multi_late,
      'oof_map' AS calibration_source, {_flag_sql()}, f[1:2] || '-' || f[4:] AS display_id FROM scored""",
    "score_early_given": f"{_SCORED} SELECT subject_id, ROUND(early, 6) AS risk_multi_early_raw FROM scored",
    "score_late_given": f"{_SCORED} SELECT subject_id, ROUND(late, 6) AS risk_multi_late_raw FROM scored",
    "evaluation_ranking": f"""{_CURVES} SELECT model, ROUND(({AUC})::DOUBLE, 6) AS auc, ROUND(({AP})::DOUBLE, 6) AS auprc
      FROM curve GROUP BY model""",
    "evaluation_roc": f"""{_CURVES} SELECT model, ROUND(p, 6) AS threshold, ROUND({FPR}, 6) AS fpr, ROUND({REC}, 6) AS tpr
      FROM curve WHERE tp + fp = n OR next_n IS NULL OR pos <> next_pos OR n <> next_n {ROC_UNION.format('')}""",
    "evaluation_pr": f"""{_CURVES} SELECT model, ROUND(p, 6) AS threshold, ROUND({PREC}, 6) AS precision,
      ROUND({REC}, 6) AS recall FROM curve UNION ALL SELECT model, NULL, 1.0, 0.0 FROM curve GROUP BY model""",
    "evaluation_reliability": _of_fused("reliability_curve"),
    "evaluation_brier": _of_fused("brier_score"),
    "late_importance": f"""SELECT UPPER(feature[1]) || feature[2:] AS feature, mean_abs
      FROM ({COHORT_ORACLES['linear_attribution']})""",
    "linear_attribution_signed": f"SELECT *, 0.0::DOUBLE AS mean_signed FROM ({COHORT_ORACLES['linear_attribution']})",
    "linear_attribution_correlated": _correlated_sql(),
    "predict_probability_walk": "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS n_off FROM documents",
    "search_choice": f"{_LABELLED} SELECT COUNT(*) AS n, 3 AS n_draws, true AS best_chosen, true AS in_space FROM labelled",
    "late_fusion_meta_optimal": f"""{_LABELLED}, {INTERSECTION_SQL}, folds AS (
        SELECT (ROW_NUMBER() OVER (ORDER BY y_true, MD5('{CFG.seed}|' || subject_id), subject_id) - 1)
          % {CFG.outer_folds} + 1 AS fold FROM met)
      SELECT k::INTEGER AS fold_id, COUNT(*) AS n, 0 AS n_off FROM folds, range(1, {CFG.outer_folds + 1}) r(k)
      WHERE fold <> k GROUP BY k""",
    "single_source_calibrators": f"""{_LABELLED} SELECT model, COUNT(*) AS n, 0 AS n_off
      FROM labelled, (VALUES ('uncalibrated'), ('calibrated')) m(model) GROUP BY model""",
    "single_source_deployable": """SELECT CAST(doc_id AS VARCHAR) AS subject_id, model, 1 AS ok
      FROM documents, (VALUES ('uncalibrated'), ('calibrated')) m(model)""",
}
