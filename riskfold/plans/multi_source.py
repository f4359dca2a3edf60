"""Nested evaluation of several sources on shared outer folds.

Single-source baselines, early fusion and late fusion all predict the same held-out
subjects of the intersection cohort. Late fusion trains its base models on the expanded
cohorts minus every held-out id, so that no subject is ever scored by a model that saw
it. The scores of each late base fit and of each outer fold are written to the shared folder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import meta_feature_name
from riskfold.functions.scaling import fits_one_task, written
from riskfold.operators import attribution, calibration
from riskfold.operators.cohort import (
    ID,
    LABEL,
    guard_complete,
    guard_labels,
    join_intersection,
    join_label,
    join_probability,
)
from riskfold.operators.folds import (
    ATTRIBUTION_SEED,
    CALIBRATION_SEED,
    FINAL_SEED,
    derive_seed,
    nested_folds,
    sample_rows,
    source_seed,
    stratified_folds,
)
from riskfold.operators.models import (
    FittedForest,
    MetaModel,
    SearchConfig,
    assemble_oof,
    fit_meta,
    fit_tuned,
    in_parallel,
    union_all,
)
from riskfold.operators.summaries import finite_filter
from riskfold.plans.calibrated import calibrated_forest, calibrated_meta

OUT = [ID, "fold_id", LABEL]
META = "multi_late_meta"
Forests = dict[tuple[str, int], FittedForest]  # by model and outer fold


@dataclass
class Cohorts:
    """Labelled cohorts of a run.

    ``wide`` is the intersection, ``expanded`` the cohort of each source. Both carry the
    outer fold of the subject and its inner fold under every outer fold, null for subjects
    outside the intersection: holding subjects out is a filter, not a join. They are stored by
    outer fold, so the files of a fold that is held out are not read.
    """

    wide: DataFrame
    expanded: dict[str, DataFrame]
    columns: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    @property
    def all_columns(self) -> list[str]:
        return [c for cols in self.columns.values() for c in cols]

    def train(self, fold: int) -> DataFrame:
        return self.wide.filter(F.col("fold_id") != fold)

    def test(self, fold: int) -> DataFrame:
        return self.wide.filter(F.col("fold_id") == fold)

    def base_train(self, name: str, fold: int, inner: int | None = None) -> DataFrame:
        """Expanded rows of one source outside the outer-test and inner-validation sets."""
        kept = F.col("fold_id") != fold
        if inner is not None:
            kept = kept & (F.col(inner_fold(fold)) != inner)
        return self.expanded[name].filter(F.col("fold_id").isNull() | kept)

    def base_held(self, name: str, fold: int, inner: int | None = None) -> DataFrame:
        """Expanded rows of the held-out subjects: outer-test, or inner-validation."""
        if inner is None:
            return self.expanded[name].filter(F.col("fold_id") == fold)
        held = (F.col("fold_id") != fold) & (F.col(inner_fold(fold)) == inner)
        return self.expanded[name].filter(held)


RESERVED = (ID, LABEL, "fold_id")


def inner_fold(fold: int) -> str:
    """Column with the inner fold under an outer fold."""
    return f"inner_fold_{fold}"


def build_cohorts(
    features: Mapping[str, DataFrame], labels: DataFrame, cfg: SearchConfig, order: Sequence[str] = ()
) -> Cohorts:
    """Expanded cohorts and the intersection, with every fold of the run assigned.

    Each is written once: every fit of the run starts from a filtered scan of it. So are the
    sources and the intersection before they get their folds, as both are read several times.
    """
    spark = labels.sparkSession
    columns = {n: [c for c in df.columns if c != ID] for n, df in features.items()}
    folds = range(1, cfg.outer_folds + 1)
    reserved = [*RESERVED, *map(inner_fold, folds)]
    every = [c.lower() for cols in columns.values() for c in cols] + reserved
    if len(set(every)) < len(every):
        raise ValueError(f"feature names must differ between sources and from {reserved}")
    jobs = [lambda: guard_labels(written(labels, "labels"), "labels")]
    jobs += [(lambda n=n, df=df: written(df, f"source-{n}")) for n, df in features.items()]
    labels, *sources = in_parallel(spark, jobs, cfg.parallelism)
    features = dict(zip(features, sources))
    wide = written(join_intersection(features, labels, order=order), "intersection-rows")
    few = fits_one_task(wide.count())
    outer = stratified_folds(wide.select(ID, LABEL), cfg.outer_folds, cfg.seed, few=few)
    inner = nested_folds(outer, cfg.outer_folds, cfg.inner_folds, cfg.seed, few=few)
    flat = [F.max(F.when(F.col("outer_fold") == k, F.col("inner_fold"))).alias(inner_fold(k)) for k in folds]
    plan = written(inner.groupBy(ID, "fold_id").agg(*flat), "folds")

    def expanded(n: str) -> DataFrame:
        rows = join_label(features[n], labels).join(plan, ID, "left")
        return written(rows, f"expanded-{n}", by="fold_id")

    jobs = [lambda: written(wide.join(plan, ID), "intersection", by="fold_id")]
    jobs += [(lambda n=n: expanded(n)) for n in features]
    wide_folds, *others = in_parallel(spark, jobs, cfg.parallelism)
    guard_labels(wide_folds, "intersection cohort")
    return Cohorts(wide_folds, dict(zip(features, others)), columns)


def _labelled(df: DataFrame, model: str) -> DataFrame:
    return df.select(*OUT, F.lit(model).alias("model"), "p")


def single_source_fold(
    c: Cohorts, name: str, fold: int, cfg: SearchConfig, forests: Forests | None = None
) -> DataFrame:
    """Held-out probabilities of one source's forest trained on the intersection.

    ``forests`` takes the fitted forest, here and below.
    """
    seed = derive_seed("single", fold, name)
    model = fit_tuned(c.train(fold), c.columns[name], cfg, seed)
    if forests is not None:
        forests[f"single_{name}", fold] = model
    return _labelled(model.predict(c.test(fold), OUT), f"single_{name}")


def early_fold(
    c: Cohorts,
    fold: int,
    cfg: SearchConfig,
    method: str | None,
    calibration_folds: int,
    forests: Forests | None = None,
) -> list[DataFrame]:
    """Held-out probabilities of the forest over all sources, raw and calibrated."""
    train, test = c.train(fold), c.test(fold)
    model = fit_tuned(train, c.all_columns, cfg, derive_seed("early", fold))
    if forests is not None:
        forests["multi_early", fold] = model
    out = [_labelled(model.predict(test, OUT), "multi_early")]
    if method:
        seed = cfg.seed + CALIBRATION_SEED["early"] + fold
        cal = calibrated_forest(model, train, method, calibration_folds, seed, cfg)
        out.append(_labelled(cal.predict(test, OUT), "multi_early_cal"))
    return out


def _inner_jobs(c: Cohorts, fold: int, cfg: SearchConfig) -> dict[tuple[int, str], Callable]:
    """One base fit per inner fold and source; each writes its scores, so its forest can go."""

    def task(j: int, name: str):
        seed = derive_seed("late_inner", fold, name, j)
        model = fit_tuned(c.base_train(name, fold, j), c.columns[name], cfg, seed)
        return written(model.predict(c.base_held(name, fold, j)), f"inner-oof-{fold}")

    return {
        (j, n): (lambda j=j, n=n: task(j, n)) for j in range(1, cfg.inner_folds + 1) for n in c.names
    }


def _meta_rows(c: Cohorts, fold: int, scored: Mapping[tuple[int, str], DataFrame]) -> DataFrame:
    rows = c.train(fold).select(*OUT, F.col(inner_fold(fold)).alias("inner_fold"))
    for name in c.names:
        rows = join_probability(rows, union_all(d for (_, n), d in scored.items() if n == name), f"p_{name}")
    rows = written(rows, f"meta-train-{fold}")
    return guard_complete(rows, [f"p_{n}" for n in c.names], f"meta-training rows of fold {fold}")


def inner_oof(c: Cohorts, fold: int, cfg: SearchConfig) -> DataFrame:
    """Meta-training rows of one outer fold: ``id, fold_id, y_true, p_<source>...``.

    For every inner fold and source the base model trains on the expanded cohort minus
    the outer-test and inner-validation ids and scores the validation ids.
    """
    return _meta_rows(c, fold, _all_done(c, _inner_jobs(c, fold, cfg), cfg))


def _base_jobs(c: Cohorts, fold: int, cfg: SearchConfig) -> dict[str, Callable]:
    def task(name: str):
        seed = derive_seed("late_base", fold, name)
        model = fit_tuned(c.base_train(name, fold), c.columns[name], cfg, seed)
        return written(model.predict(c.base_held(name, fold)), f"base-scores-{fold}")

    return {n: (lambda n=n: task(n)) for n in c.names}


def _base_rows(c: Cohorts, fold: int, scored: Mapping[str, DataFrame]) -> DataFrame:
    rows = c.test(fold).select(*OUT)
    for name in c.names:
        rows = join_probability(rows, scored[name], f"p_{name}")
    rows = written(rows, f"base-test-{fold}")
    return guard_complete(rows, [f"p_{n}" for n in c.names], f"base probabilities of fold {fold}")


def base_test(c: Cohorts, fold: int, cfg: SearchConfig) -> DataFrame:
    """Base probabilities of the outer-test subjects: ``id, fold_id, y_true, p_<source>...``."""
    return _base_rows(c, fold, _all_done(c, _base_jobs(c, fold, cfg), cfg))


def _all_done(c: Cohorts, jobs: Mapping, cfg: SearchConfig) -> dict:
    """The results of the jobs by their keys."""
    return dict(zip(jobs, in_parallel(c.wide.sparkSession, list(jobs.values()), cfg.parallelism)))


def late_fold(
    c: Cohorts,
    fold: int,
    cfg: SearchConfig,
    method: str | None,
    calibration_folds: int,
    meta_rows: DataFrame,
    test: DataFrame,
) -> tuple[list[DataFrame], DataFrame, MetaModel]:
    """Held-out base, late and calibrated late probabilities; meta-training rows; meta-model.

    ``meta_rows`` and ``test`` come from ``inner_oof`` and ``base_test``.
    """
    jobs = [lambda: fit_meta(meta_rows, c.names)]
    if method:
        seed = cfg.seed + CALIBRATION_SEED["late"] + fold
        jobs.append(lambda: calibrated_meta(meta_rows, c.names, method, calibration_folds, seed))
    meta, *cals = in_parallel(meta_rows.sparkSession, jobs, len(jobs))
    out = [
        _labelled(test.withColumn("p", F.col(f"p_{n}")), f"base_{n}") for n in c.names
    ]
    out.append(_labelled(test.withColumn("p", meta.probability()), "multi_late"))
    for cal in cals:
        out.append(_labelled(cal.predict(test), "multi_late_cal"))
    return out, meta_rows, meta


@dataclass
class Run:
    """Out-of-fold stream of a run; by fold its meta-training rows, meta-models and forests."""

    oof: DataFrame
    meta_rows: dict[int, DataFrame] = field(default_factory=dict)
    metas: dict[int, MetaModel] = field(default_factory=dict)
    forests: Forests = field(default_factory=dict)

    def wide(self, names: Sequence[str]) -> DataFrame:
        return assemble_oof(self.oof, names)


def evaluate(
    c: Cohorts,
    cfg: SearchConfig,
    method: str | None = "sigmoid",
    calibration_folds: int = 5,
    stages: Sequence[str] = ("single", "early", "late"),
) -> Run:
    """Every model on every outer fold: the long stream ``(id, fold_id, y_true, model, p)``.

    The fits of all outer folds wait in one queue, so no fold idles while another's last fit runs,
    and whoever ends the last fit of a fold finishes that fold.
    """
    run, folds = Run(c.wide), range(1, cfg.outer_folds + 1)
    jobs = {}
    for fold in folds:
        if "early" in stages:
            early = lambda k=fold: early_fold(c, k, cfg, method, calibration_folds, run.forests)
            jobs[fold, "frames", ""] = early
        if "single" in stages:
            jobs |= {
                (fold, "frames", n): (lambda n=n, k=fold: [single_source_fold(c, n, k, cfg, run.forests)])
                for n in c.names
            }
        if "late" in stages:
            jobs |= {(fold, "inner", k): job for k, job in _inner_jobs(c, fold, cfg).items()}
            jobs |= {(fold, "base", k): job for k, job in _base_jobs(c, fold, cfg).items()}
    done, parts, lock = {}, {}, Lock()
    left = Counter(fold for fold, _, _ in jobs)

    def of(fold: int, kind: str) -> dict:
        return {k: done[f, what, k] for f, what, k in jobs if (f, what) == (fold, kind)}

    def finish(fold: int):
        frames = [f for part in of(fold, "frames").values() for f in part]
        if "late" in stages:
            both = [
                lambda: _meta_rows(c, fold, of(fold, "inner")),
                lambda: _base_rows(c, fold, of(fold, "base")),
            ]
            meta_rows, test = in_parallel(c.wide.sparkSession, both, len(both))
            late, run.meta_rows[fold], run.metas[fold] = late_fold(
                c, fold, cfg, method, calibration_folds, meta_rows, test
            )
            frames += late
        return written(union_all(frames), f"oof-{fold}")

    def task(key: tuple):
        out = jobs[key]()
        with lock:
            done[key] = out
            left[key[0]] -= 1
            last = not left[key[0]]
        if last:
            parts[key[0]] = finish(key[0])

    _all_done(c, {key: (lambda key=key: task(key)) for key in jobs}, cfg)
    # Threads fill these in any order.
    run.forests = dict(sorted(run.forests.items()))
    run.meta_rows, run.metas = ({k: d[k] for k in folds if k in d} for d in (run.meta_rows, run.metas))
    run.oof = guard_complete(union_all(parts[k] for k in folds), ["p"], "out-of-fold stream")
    return run


def fold_attribution(
    run: Run, c: Cohorts, cfg: SearchConfig, max_rows: int | None = None
) -> DataFrame:
    """``model, fold_id, feature, mean_abs, mean_signed``: what each fold's models rest on.

    Forests are explained on the rows they were trained on, all of them in one job; ``max_rows``
    asks for a seeded sample of each fold. The meta-model is split over its inputs.
    """
    parts = []
    if run.forests:
        explained = []
        for (model, fold), fitted in sorted(run.forests.items()):
            seed = cfg.seed + ATTRIBUTION_SEED[model.split("_")[0]] + fold
            rows = sample_rows(c.train(fold), max_rows, seed)
            explained.append(attribution.Explained(model, fold, fitted, rows))
        parts.append(attribution.fold_attribution(explained))
    for fold, meta in sorted(run.metas.items()):
        named = {f"p_{n}": b for n, b in meta.coefficients.items()}
        out = attribution.linear_attribution(run.meta_rows[fold], named)
        out = out.withColumn("feature", meta_feature_name(F.col("feature")))
        parts.append(out.select(F.lit(META).alias("model"), F.lit(fold).alias("fold_id"), *out.columns))
    return union_all(parts)


def mean_attribution(folds: DataFrame, cfg: SearchConfig) -> DataFrame:
    """``model, feature, mean_abs``: the mean over the outer folds of ``fold_attribution``."""
    return attribution.average_attribution(folds, cfg.outer_folds, ["model"])


# ---------------------------------------------------------------- deployment


@dataclass
class FinalModels:
    """Models refitted on whole cohorts for scoring new subjects."""

    singles: dict[str, FittedForest]
    early: FittedForest
    bases: dict[str, FittedForest]
    meta: MetaModel
    calibrators: dict[str, calibration.Calibrator] = field(default_factory=dict)
    calibrator_meta: dict[str, dict] = field(default_factory=dict)


def fit_final(
    c: Cohorts, cfg: SearchConfig, meta_rows: DataFrame | None = None, singles: bool = True
) -> FinalModels:
    """Singles and early on the intersection, bases on their expanded cohorts, and the meta.

    The meta-model trains on probabilities the bases give their own training subjects
    unless out-of-fold ``meta_rows`` are handed in.
    """
    jobs = {}
    if singles:
        jobs |= {
            ("single", n): (c.wide, c.columns[n], FINAL_SEED["single"] + source_seed(n)) for n in c.names
        }
    jobs["early", ""] = (c.wide, c.all_columns, FINAL_SEED["early"])
    jobs |= {
        ("base", n): (c.expanded[n], c.columns[n], FINAL_SEED["late_base"] + source_seed(n))
        for n in c.names
    }
    fits = in_parallel(
        c.wide.sparkSession,
        [(lambda a=a: fit_tuned(a[0], a[1], cfg, a[2])) for a in jobs.values()],
        cfg.parallelism,
    )
    done = dict(zip(jobs, fits))
    bases = {n: done["base", n] for n in c.names}
    if meta_rows is None:
        rows = c.wide.select(ID, LABEL)
        for n in c.names:
            rows = rows.join(bases[n].predict(c.wide, name=f"p_{n}"), ID)
        meta_rows = written(rows, "meta-final")
    return FinalModels(
        {n: done["single", n] for n in c.names} if singles else {},
        done["early", ""],
        bases,
        fit_meta(meta_rows, c.names),
    )


def fit_oof_calibrators(
    oof: DataFrame, method: str = "sigmoid", clip: float = calibration.CLIP
) -> dict[str, calibration.Calibrator]:
    """Maps for the two fused streams; empty unless both have both classes."""

    def of(k: str) -> calibration.Calibrator | None:
        return calibration.fit_calibrator(oof.filter(F.col("model") == f"multi_{k}"), method, clip=clip)

    both = ("early", "late")
    jobs = [(lambda k=k: of(k)) for k in both]
    fitted = dict(zip(both, in_parallel(oof.sparkSession, jobs, len(jobs))))
    return {} if any(v is None for v in fitted.values()) else fitted


def add_oof_calibrators(
    models: FinalModels, oof: DataFrame, method: str = "sigmoid", clip: float = calibration.CLIP
) -> FinalModels:
    """Fit the maps of the fused streams and note what each was fitted on."""
    rows = finite_filter(oof.filter(F.col("model").isin("multi_early", "multi_late")))
    both = [
        lambda: fit_oof_calibrators(oof, method, clip),
        lambda: calibration.calibrator_meta(rows, method, clip, by=["model"]).collect(),
    ]
    models.calibrators, described = in_parallel(oof.sparkSession, both, len(both))
    for r in described:
        k = r.model.removeprefix("multi_")
        if k in models.calibrators:
            models.calibrator_meta[k] = {f: r[f] for f in r.__fields__ if f != "model"}
    return models
