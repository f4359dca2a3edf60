"""Documents as subjects: sources, cohorts, joins, folds, features, flags, attribution tables."""

from __future__ import annotations

import json
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions import scalars
from riskfold.functions.scaling import shared_dir, written
from riskfold.operators import attribution, blocks, calibration, cohort, curves, features, folds
from riskfold.operators import isotonic, models, summaries, thresholds
from riskfold.plans import scoring
from riskfold.sources import tables
from workloads.lines import PICKED, SCORES_SQL, _finite, scores, table, tidy, wide_scores
from workloads.lines import _curve

POPULATIONS = ("en", "fr", "de")
GROUPS = tuple(f"src{i}" for i in range(1, 16))
SEED, OUTER, INNER = 42, 5, 3
TEXT_COLUMNS = ["n_chars", "n_len", "n_digits", "n_lines", "n_spaces"]
PLATT_A, PLATT_B = 2.5, -1.25


# ---------------------------------------------------------------- fixture


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label, if it has one, and the filter columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(marks, "doc_id", "left").select(
        F.lpad(F.col("doc_id").cast("string"), 7, "0").alias("subject_id"), "lang", "source", "toxic", "quality"
    )


def _removed(text, pattern):
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def sources(spark: SparkSession, sf_dir: str) -> dict[str, cohort.Source]:
    """Three feature tables whose ids are written three different ways."""
    docs = table(spark, sf_dir, "documents")
    ident = F.col("doc_id").cast("string")
    text = F.col("text")
    meta = docs.select(F.concat(F.lit("  "), ident, F.lit(" ")).alias("subject_id"), "lang", "source")
    texts = docs.select(
        ident.alias("subject_id"),
        "n_chars",
        F.length(text).alias("n_len"),
        _removed(text, "[0-9]").alias("n_digits"),
        _removed(text, "\n").alias("n_lines"),
        _removed(text, " ").alias("n_spaces"),
    )
    vec = table(spark, sf_dir, "embeddings")
    vector = vec.select(
        F.lpad(F.col("vec_id").cast("string"), 7, "0").alias("subject_id"),
        *[F.col("embedding")[i].cast("double").alias(f"v:{i}") for i in range(64)],
        "label",
    )
    return {
        "meta": cohort.Source("meta", meta, ["lang", "source"]),
        "text": cohort.Source("text", texts, None),
        "vector": cohort.Source("vector", vector, ":"),
    }


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of every population."""
    return phenotype(spark, sf_dir).filter("toxic is not null").select(
        scalars.normalize_id(F.col("subject_id")).alias("subject_id"), F.col("toxic").alias("y_true")
    )


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: cohort.select_source(s) for n, s in sources(spark, sf_dir).items()}


def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.join_intersection(frames(spark, sf_dir), labels(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(labels(spark, sf_dir), OUTER, SEED)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


# ---------------------------------------------------------------- queries


def _scan_table(spark, sf):
    path = tables.write_table(table(spark, sf, "customer"), _scratch(spark, "customer.csv"))
    return tables.scan_table(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def _require_columns(spark, sf):
    docs = tables.require_columns(table(spark, sf, "documents"), ["doc_id", "lang", "source"])
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def _trim_headers(spark, sf):
    ragged = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" c_custkey"), F.col("c_mktsegment").alias("c_mktsegment\t ")
    )
    return tables.trim_headers(ragged)


def _resolve_alias(spark, sf):
    aliased = thresholds.threshold_set(_curve(spark, sf)).toDF(" estimator", "rule ", "thr")
    return tidy(tables.canonical_thresholds(aliased))


def _optional_source(spark, sf):
    found = {
        n: tables.optional_source(spark, f"{sf}/{n}.parquet") for n in ("documents", "labels", "absent")
    }
    return models.union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
            for n, df in found.items()
            if df is not None
        ]
    )


def _write_table(spark, sf):
    result = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("top")
    )
    path = tables.write_table(result, _scratch(spark, "orders.csv"))
    return tables.scan_table(
        spark, path, "o_orderstatus string, o_orderpriority string, n bigint, top double"
    )


def _write_report(spark, sf):
    """Nested report of ranking and thresholds, written as JSON and read back."""
    report = scoring.run_report(scores(spark, sf))
    path = tables.write_report(report, _scratch(spark, "report"))
    back = spark.read.schema(report.schema).json(path)
    return tidy(
        back.select("model", "oof_auc", "n", F.explode("thresholds").alias("threshold_name", "threshold"))
    )


def _training_columns(spark, sf):
    """Ordered input columns of every source, with the rows they were taken from."""
    out = []
    for name, s in sources(spark, sf).items():
        listed = json.dumps(cohort.feature_columns(s.frame, s.rule))
        out.append(
            s.frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("name"),
                "n_rows",
                F.posexplode(F.from_json(F.lit(listed), "array<string>")).alias("position", "input"),
            )
        )
    return models.union_all(out)


def _ids(spark, sf):
    raw = [s.frame.select("subject_id") for s in sources(spark, sf).values()]
    raw.append(phenotype(spark, sf).select("subject_id"))
    return models.union_all(raw).select(
        F.col("subject_id").alias("raw"), scalars.normalize_id(F.col("subject_id")).alias("id")
    )


def _train_filter(spark, sf):
    return cohort.filter_training(
        phenotype(spark, sf), "lang", POPULATIONS, "source", GROUPS, "toxic"
    )


def _score_filter(spark, sf):
    return cohort.filter_scoring(
        phenotype(spark, sf), "lang", POPULATIONS, "source", GROUPS, "toxic"
    )


def _unlabelled(spark, sf):
    """Documents without a usable label, once per way the label may be typed."""
    base = phenotype(spark, sf)
    text = base.withColumn("toxic", F.col("toxic").cast("string"))
    half = base.withColumn("toxic", F.col("toxic") / 2)
    spelled = base.withColumn("toxic", (F.col("toxic") / 2).cast("string"))
    absent = base.drop("toxic")
    kinds = {"number": base, "text": text, "half": half, "spelled": spelled, "absent": absent}
    return models.union_all(
        [
            cohort.select_unlabelled(df, "toxic").select(F.lit(k).alias("kind"), "subject_id")
            for k, df in kinds.items()
        ]
    )


def _source_columns(spark, sf):
    f = frames(spark, sf)
    return models.union_all(
        [
            df.select(
                F.lit(n).alias("name"),
                "subject_id",
                F.lit(len(df.columns) - 1).alias("n_columns"),
            )
            for n, df in f.items()
        ]
    )


def _dedup(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")
    )
    return cohort.dedup_keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


def _odd_scores(spark, sf):
    """Line scores where some probabilities are null, NaN or infinite."""
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linestatus") == "O", (F.col("l_returnflag") == "R").cast("int"))
        .when(F.col("l_returnflag") == "A", 0).alias("y_true"),
        F.when(d == 0, F.lit(None)).when(t == 0, F.lit(float("nan")))
        .when(d == 0.01, F.lit(float("inf"))).otherwise(t / d).alias("p"),
    )


def _finite_rows(spark, sf):
    return tidy(summaries.finite_filter(_odd_scores(spark, sf)))


def _coerce(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
        .otherwise(F.substring("o_orderpriority", 1, 1))
        .alias("raw"),
    )
    return tidy(raw.select("o_orderkey", scalars.coerce_numeric(F.col("raw")).alias("value")))


def _clip(spark, sf):
    p = F.col("l_discount") * 11 - 0.05
    return tidy(
        table(spark, sf, "lineitem").select(
            "l_orderkey",
            scalars.clip_probability(p, 0.01).alias("clipped"),
            scalars.clip_probability(p, 0.0).alias("same"),
            scalars.clamp(p, 0.0, 1.0).alias("unit"),
        )
    )


def _format_id(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.format_subject_id(F.col("o_orderkey") * 997).alias("shown")
    )


def _names(spark, sf):
    prefix = F.element_at(
        F.array(*[F.lit(x) for x in ("num__", "cat__", "remainder__", "num__cat__", "")]),
        (F.col("p_partkey") % 5 + 1).cast("int"),
    )
    raw = F.concat(prefix, F.col("p_name"), F.when(F.col("p_size") > 25, F.lit(" EU")).otherwise(F.lit("")))
    return table(spark, sf, "part").select(
        "p_partkey",
        scalars.strip_feature_name(raw).alias("stripped"),
        scalars.clean_feature_name(raw).alias("cleaned"),
        scalars.meta_feature_name(F.concat(F.lit("p_"), F.lower("p_brand"))).alias("meta"),
    )


def _join_label(spark, sf):
    return cohort.join_label(frames(spark, sf)["text"], _train_filter(spark, sf))


def _join_intersection(spark, sf):
    return tidy(
        intersection(spark, sf).select(
            "subject_id", "lang", "source", *TEXT_COLUMNS,
            F.col("`v:0`").alias("v0"), F.col("`v:63`").alias("v63"), "y_true",
        )
    )


def _holdouts(spark, sf):
    f = folded(spark, sf)
    return f.filter("fold_id = 1"), f.filter("fold_id = 2")


def _probability_lookup(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("subject_id"))
    probs = table(spark, sf, "events").select(
        F.concat(F.lit("00"), F.col("user_id").cast("string")).alias("subject_id"),
        "ts", "event_id", (F.col("value") / 1000).alias("p"),
    )
    return tidy(cohort.join_probability(rows, probs, "p_events", ["ts", "event_id"]))


def _completeness(spark, sf):
    rows = phenotype(spark, sf).withColumn("subject_id", scalars.normalize_id(F.col("subject_id")))
    vec = frames(spark, sf)["vector"].select("subject_id", F.col("`v:0`").alias("p"))
    joined = cohort.join_probability(rows, vec, "p_vector").select("lang", "toxic", "p_vector")
    return cohort.completeness(joined, ["p_vector", "toxic"], ["lang"])


def _split_types(spark, sf):
    out = []
    for name in ("documents", "embeddings", "customer"):
        df = table(spark, sf, name)
        numeric, categorical = features.split_feature_types(df, df.columns)
        for kind, cols in (("numeric", numeric), ("categorical", categorical)):
            if not cols:
                continue
            cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n")) for c in cols])
            counts = df.agg(*[F.count(c).alias(f"n_{c}") for c in cols])
            out.append(counts.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.inline(cells)))
    return models.union_all(out)


def _one_hot(spark, sf):
    """Levels learned on labelled English and French documents, applied to all of them."""
    docs = cohort.select_source(sources(spark, sf)["meta"]).join(
        frames(spark, sf)["text"].select("subject_id", "n_chars"), "subject_id"
    )
    train = docs.filter(F.col("lang").isin("en", "fr")).join(labels(spark, sf), "subject_id", "left_semi")
    numeric, categorical = ["n_chars"], ["lang"]
    prep = features.fit_preparation(
        features.prepare_inputs(train, numeric, categorical), numeric, categorical
    )
    names = features.feature_names(prep, numeric)
    out = prep.transform(features.prepare_inputs(docs, numeric, categorical, ["subject_id"]))
    slots = vector_to_array("features")
    return out.select("subject_id", *[slots[i].alias(n) for i, n in enumerate(names)])


def _assembled(df, keep, columns):
    numeric, categorical = features.split_feature_types(df, columns)
    inputs = features.prepare_inputs(df, numeric, categorical, keep)
    prep = features.fit_preparation(inputs, numeric, categorical)
    return prep.transform(inputs).select(*keep, vector_to_array("features").alias("slots"))


def _assemble(spark, sf):
    out = _assembled(frames(spark, sf)["text"], ["subject_id"], TEXT_COLUMNS)
    return out.select(
        "subject_id", F.size("slots").alias("size"), F.col("slots")[0].alias("first"),
        F.element_at("slots", -1).alias("last"),
    )


def _early_fusion(spark, sf):
    df = intersection(spark, sf)
    columns = [c for c in df.columns if c not in ("subject_id", "y_true")]
    out = _assembled(df, ["subject_id", "y_true"], columns)
    total = F.aggregate("slots", F.lit(0.0), lambda a, x: a + x)
    return tidy(out.select("subject_id", "y_true", total.alias("total")), 4)


def _packed(spark, sf):
    """Id and the vector of every embedding as one block."""
    vec = table(spark, sf, "embeddings").withColumn("subject_id", F.col("vec_id").cast("string"))
    return blocks.pack_array(vec, "embedding", [f"v:{i}" for i in range(64)], "vector", ["subject_id"])


def _packed_columns(spark, sf):
    """The 64 columns of the vector source as a block, last slot first, one row per slot."""
    raw = frames(spark, sf)["vector"]
    names = [c for c in raw.columns if c != "subject_id"]
    block = blocks.pack(raw, names, "vector", ["subject_id"])
    turned = blocks.slice_block(block, "vector", names[::-1], "turned")
    out = blocks.unpack(turned, "turned", ["subject_id"])
    return out.withColumn("slot_number", F.lit(63) - F.substring("slot", 3, 9).cast("int"))


def _packed_fusion(spark, sf):
    """Every slot of the joined features, the vector source joined as a block."""
    df = cohort.join_intersection(
        {"text": frames(spark, sf)["text"], "vector": _packed(spark, sf)}, labels(spark, sf)
    )
    numeric, _ = features.split_feature_types(df, [*TEXT_COLUMNS, "vector"])
    slots = {"vector": blocks.slot_names(df, "vector")}
    inputs = features.prepare_inputs(df, numeric, [], ["subject_id", "y_true"], slots)
    prep = features.fit_preparation(inputs, numeric, [])
    named = F.array(*[F.lit(n) for n in features.feature_names(prep, numeric, slots)])
    cells = F.arrays_zip(named.alias("slot"), vector_to_array("features").alias("value"))
    return prep.transform(inputs).select("subject_id", "y_true", F.inline(cells).alias("slot", "value"))


def _hashed_levels(spark, sf):
    """Customers as hashed levels of their orders: rows, slots and ones of each level."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("level"))
    inputs = features.prepare_inputs(orders, [], ["level"])
    prep = features.fit_preparation(inputs, [], ["level"], hashed={"level": 1024})
    ones = F.transform(vector_to_array("features"), lambda v, i: F.when(v == 1, i))
    used = F.array_compact(ones).alias("used")
    return (
        prep.transform(inputs)
        .select("level", used)
        .groupBy("level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("used").alias("n_slots"),
            F.sum(F.size("used")).alias("n_ones"),
        )
    )


def _align(spark, sf):
    wanted = ["n_spaces", "n_missing", "n_chars"]
    out = features.prepare_inputs(frames(spark, sf)["text"], wanted, ["lang"], ["subject_id"])
    return out.select(
        "subject_id", "n_spaces", F.isnan("n_missing").alias("missing"), "n_chars", "lang"
    )


def _weights(spark, sf):
    return tidy(features.balanced_weights(labels(spark, sf)))


def _nested(spark, sf):
    return folds.nested_folds(folded(spark, sf), OUTER, INNER, SEED)


def _fold_replay(spark, sf):
    """Sizes and positives of the stored folds."""
    return folded(spark, sf).groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("n_pos")
    )


def _seeds(spark, sf):
    """Seed offset and size of every inner fit of the late fusion, per source."""
    nested = _nested(spark, sf)
    out = []
    for name in sources(spark, sf):
        seed = folds.derive_seed("late_inner", F.col("outer_fold"), name, F.col("inner_fold"))
        out.append(
            nested.groupBy("outer_fold", "inner_fold")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("name"), "outer_fold", "inner_fold", seed.cast("bigint").alias("seed"), "n")
        )
    return models.union_all(out)


def _sample(spark, sf):
    return folds.sample_rows(frames(spark, sf)["text"], 100, 7)


def _modal(spark, sf):
    best = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("fold_id"), F.col("o_orderpriority").alias("params")
    )
    return summaries.modal_best_params(best)


def _long_oof(spark, sf):
    wide = folded(spark, sf).join(frames(spark, sf)["text"], "subject_id").select(
        "subject_id", "fold_id", "y_true",
        F.least(F.col("n_chars") / 20000, F.lit(1.0)).alias("chars"),
        (F.col("n_spaces") / (F.col("n_len") + 1)).alias("spaces"),
    )
    return curves.long_streams(
        wide, ["subject_id", "fold_id", "y_true"], {"chars": "chars", "spaces": "spaces"}
    )


def _assemble_oof(spark, sf):
    return tidy(models.assemble_oof(_long_oof(spark, sf), ["chars", "spaces"]))


def _fold_attribution(spark, sf):
    events = table(spark, sf, "events").withColumn("fold_id", F.col("event_id") % 5 + 1)
    missing = (F.col("fold_id") == 1) & (F.col("event_type") == "click")
    return events.filter(~missing).groupBy("fold_id", F.col("event_type").alias("feature")).agg(
        F.avg(F.abs("value")).alias("mean_abs")
    )


def _top(spark, sf):
    rows = table(spark, sf, "part").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("feature"),
        F.when(F.col("p_size") % 7 == 0, F.lit("n/a"))
        .otherwise(F.col("p_retailprice").cast("string")).alias("mean_abs"),
    )
    return tidy(attribution.top_features(rows, 20))


COEFS = {"disc": 0.8, "qty": -1.2, "price": 2.0}


def _linear(spark, sf):
    out = attribution.linear_attribution(wide_scores(spark, sf), COEFS, correlated=False)
    return tidy(out.select("feature", "mean_abs"))


def _linear_correlated(spark, sf):
    return tidy(attribution.linear_attribution(wide_scores(spark, sf), COEFS, correlated=True))


FLAG_MODELS = {"disc": "multi_early", "qty": "multi_late", "price": " multi_late "}


def _flags(spark, sf):
    """How many lines each flag column marks, from thresholds chosen on the same lines."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in FLAG_MODELS.items() for x in kv]), F.col("model"))
    thr = thresholds.threshold_set(_curve(spark, sf)).withColumn("model", mapped)
    risk = F.when(F.col("y_true") == 1, F.col("disc"))
    out = wide_scores(spark, sf).select(
        risk.alias("risk_multi_early_raw"), F.col("qty").alias("risk_multi_late_raw")
    )
    flagged = scoring.binary_flags(out, thr)
    names = [c for c in flagged.columns if c.startswith("binary_")]
    counts = flagged.agg(*[F.count_if(F.col(f"`{n}`") == "Yes").alias(f"c{i}") for i, n in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(n).alias("flag"), F.col(f"c{i}").alias("n_yes")) for i, n in enumerate(names)])
    return counts.select(F.inline(cells))


def _apply_calibrator(spark, sf):
    cal = calibration.Sigmoid(PLATT_A, PLATT_B)
    s = scores(spark, sf).withColumn("p_cal", cal.apply(F.col("p")))
    return tidy(
        s.groupBy("model", "y_true").agg(
            F.avg("p_cal").alias("mean_cal"), F.min("p_cal").alias("min_cal"),
            F.max("p_cal").alias("max_cal"), F.count(F.lit(1)).alias("n"),
        )
    )


def _fit_isotonic(spark, sf):
    """Monotone map of every stream at every distinct score."""
    s = scores(spark, sf)
    knots = written(isotonic.isotonic_knots(s, ["model"]), "isotonic-knots")
    return tidy(isotonic.apply_knots(s.select("model", "p").distinct(), knots, ["model"]))


def _apply_isotonic(spark, sf):
    """Maps fitted on the other folds, at every row of the first: between knots and outside."""
    s = scores(spark, sf)
    fitted = isotonic.isotonic_knots(s.filter("fold_id <> 1"), ["model"])
    knots = written(fitted, "isotonic-knots")
    mapped = isotonic.apply_knots(s.filter("fold_id = 1"), knots, ["model"])
    return tidy(mapped.groupBy("model", "p", "p_cal").agg(F.count(F.lit(1)).alias("n")))


def _meta(spark, sf):
    clean = summaries.finite_filter(_odd_scores(spark, sf))
    return tidy(calibration.calibrator_meta(clean, "sigmoid"))


def _two_classes(spark, sf):
    """Per order status of the line: whether a calibrator may be fitted."""
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_linestatus", (F.col("l_tax") * 100).cast("int")).alias("model"),
        F.when(F.col("l_linestatus") == "O", (F.col("l_returnflag") == "R").cast("int")).otherwise(0).alias("y_true"),
        F.col("l_discount").alias("p"),
    )
    return calibration.two_classes(lines)


QUERIES = {
    "scan_table": _scan_table,
    "require_columns": _require_columns,
    "trim_headers": _trim_headers,
    "resolve_alias": _resolve_alias,
    "optional_source": _optional_source,
    "write_table": _write_table,
    "write_report": _write_report,
    "training_columns": _training_columns,
    "normalize_id": _ids,
    "cohort_filter_train": _train_filter,
    "cohort_filter_score": _score_filter,
    "select_unlabelled": _unlabelled,
    "select_modality_columns": _source_columns,
    "dedup_keep_first": _dedup,
    "finite_filter": _finite_rows,
    "coerce_numeric": _coerce,
    "clip_probability": _clip,
    "format_subject_id": _format_id,
    "clean_feature_name": _names,
    "join_label": _join_label,
    "join_intersection": _join_intersection,
    "join_anti_holdout": lambda s, d: cohort.without_ids(
        cohort.join_label(frames(s, d)["text"], labels(s, d)), *_holdouts(s, d)
    ),
    "join_semi_holdout": lambda s, d: cohort.only_ids(
        cohort.join_label(frames(s, d)["text"], labels(s, d)), *_holdouts(s, d)
    ),
    "join_probability_lookup": _probability_lookup,
    "guard_complete": _completeness,
    "split_feature_types": _split_types,
    "one_hot": _one_hot,
    "assemble_features": _assemble,
    "early_fusion": _early_fusion,
    "early_fusion_packed": _packed_fusion,
    "pack_wide_source": _packed_columns,
    "hashed_levels": _hashed_levels,
    "align_to_model": _align,
    "balanced_weights": _weights,
    "stratified_folds": folded,
    "nested_folds": _nested,
    "fold_replay": _fold_replay,
    "derive_seed": _seeds,
    "sample_rows": _sample,
    "modal_best_params": _modal,
    "assemble_oof": _assemble_oof,
    "average_attribution": lambda s, d: tidy(attribution.average_attribution(_fold_attribution(s, d), 5)),
    "top_features": _top,
    "linear_attribution": _linear,
    "linear_attribution_correlated": _linear_correlated,
    "binary_flags": _flags,
    "apply_calibrator": _apply_calibrator,
    "apply_calibrator_isotonic": _apply_isotonic,
    "fit_isotonic": _fit_isotonic,
    "calibrator_meta": _meta,
    "guard_two_classes": _two_classes,
}

# ---------------------------------------------------------------- oracles

_POPS = ", ".join(f"'{p}'" for p in POPULATIONS)
_GROUPS = ", ".join(f"'{g}'" for g in GROUPS)
TEXT_SQL = r"""
  texts AS (
    SELECT CAST(doc_id AS VARCHAR) AS subject_id, n_chars, CAST(LENGTH(text) AS INTEGER) AS n_len,
           CAST(LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '[0-9]', '', 'g')) AS INTEGER) AS n_digits,
           CAST(LENGTH(text) - LENGTH(REPLACE(text, chr(10), '')) AS INTEGER) AS n_lines,
           CAST(LENGTH(text) - LENGTH(REPLACE(text, ' ', '')) AS INTEGER) AS n_spaces
    FROM documents)"""
LABELS_SQL = """
  labelled AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS subject_id, l.toxic AS y_true
    FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL)"""
FOLDED_SQL = f"""
  folded AS (
    SELECT subject_id, y_true, CAST((ROW_NUMBER() OVER (
             ORDER BY y_true, MD5('{SEED}|' || subject_id), subject_id) - 1) % {OUTER} + 1 AS INTEGER) AS fold_id
    FROM labelled)"""
NESTED_SQL = f"""
  nested AS (
    SELECT subject_id, y_true, fold_id, outer_fold, CAST((ROW_NUMBER() OVER (PARTITION BY outer_fold
             ORDER BY y_true, MD5(CAST({SEED} + outer_fold AS VARCHAR) || '|' || subject_id), subject_id) - 1)
             % {INNER} + 1 AS INTEGER) AS inner_fold
    FROM folded, (SELECT CAST(k AS INTEGER) AS outer_fold FROM range(1, {OUTER + 1}) r(k)) WHERE fold_id <> outer_fold)"""
ODD_SQL = """
  odd AS (
    SELECT l_orderkey,
      CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END
           WHEN l_returnflag = 'A' THEN 0 END AS y_true,
      CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN 'nan'::DOUBLE
           WHEN l_discount = 0.01 THEN 'inf'::DOUBLE ELSE l_tax / l_discount END AS p FROM lineitem),
  clean AS (SELECT * FROM odd WHERE p IS NOT NULL AND isfinite(p) AND y_true IS NOT NULL)"""
_TOXIC = "documents d LEFT JOIN labels l USING (doc_id)"
_PAD = "LPAD(CAST(doc_id AS VARCHAR), 7, '0')"
_VECTOR_NAMES = ", ".join(f"'v:{i}'" for i in range(64))


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _seed_sql() -> str:
    names = {n: folds.source_seed(n) for n in ("meta", "text", "vector")}
    return _union(
        [
            f"""SELECT '{n}' AS name, outer_fold, inner_fold, CAST(3000 * outer_fold + 10 * inner_fold + {v} AS BIGINT)
            AS seed, COUNT(*) AS n FROM nested GROUP BY outer_fold, inner_fold"""
            for n, v in names.items()
        ]
    )


def _hull_sql(rows: str = "scores") -> str:
    """Corners of the convex minorant of the running sums, found from one to the next.

    Slopes between corners are the monotone fit. Of equally steep points the farthest is next.
    """
    return f"""g AS (SELECT model, p, SUM(y_true)::DOUBLE AS pos, COUNT(*)::DOUBLE AS n FROM {rows} GROUP BY model, p),
      c AS (SELECT model, p, SUM(pos) OVER w AS cp, SUM(n) OVER w AS cn, LEAD(p) OVER (PARTITION BY model ORDER BY p) AS after
            FROM g WINDOW w AS (PARTITION BY model ORDER BY p)),
      hull(model, cp, cn, lo, hi, slope, after) AS (
        SELECT model, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, MIN(p) FROM c GROUP BY model
        UNION ALL
        SELECT model, best.cp, best.cn, after, best.p, best.slope, best.after FROM (
          SELECT h.model, h.after, ARG_MIN({{'cp': c.cp, 'cn': c.cn, 'p': c.p, 'after': c.after,
                   'slope': (c.cp - h.cp) / (c.cn - h.cn)}}, ((c.cp - h.cp) / (c.cn - h.cn), -c.cn)) AS best
          FROM hull h JOIN c ON c.model = h.model AND c.cn > h.cn GROUP BY h.model, h.after) s),
      blocks AS (SELECT model, lo, hi, slope FROM hull WHERE slope IS NOT NULL)"""


def _isotonic_sql() -> str:
    return f"""WITH RECURSIVE {SCORES_SQL}, {_hull_sql()}
      SELECT c.model, ROUND(p, 6) AS p, ROUND(slope, 6) AS p_cal
      FROM c ASOF JOIN blocks b ON b.model = c.model AND b.lo <= c.p"""


def _apply_isotonic_sql() -> str:
    return f"""WITH RECURSIVE {SCORES_SQL}, others AS (SELECT * FROM scores WHERE fold_id <> 1), {_hull_sql("others")},
      knots AS (SELECT model, lo AS x, slope AS y FROM blocks UNION SELECT model, hi, slope FROM blocks),
      asked AS (SELECT model, p, COUNT(*) AS n FROM scores WHERE fold_id = 1 GROUP BY model, p),
      near AS (SELECT a.model, a.p, a.n, l.x AS x0, l.y AS y0, h.x AS x1, h.y AS y1
        FROM asked a ASOF LEFT JOIN knots l ON l.model = a.model AND l.x <= a.p
        ASOF LEFT JOIN knots h ON h.model = a.model AND h.x >= a.p)
      SELECT model, ROUND(p, 6) AS p, n, ROUND(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0
        ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END, 6) AS p_cal FROM near"""


_LINE_ORDER = (
    "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus"
)

ORACLES = {
    "scan_table": "SELECT * FROM customer",
    "require_columns": "SELECT lang, source, COUNT(*) AS n FROM documents GROUP BY lang, source",
    "trim_headers": "SELECT c_custkey, c_mktsegment FROM customer",
    "resolve_alias": f"""{PICKED} SELECT model, threshold_name,
      {_finite('threshold', 'threshold')} FROM picks""",
    "optional_source": """SELECT 'documents' AS name, COUNT(*) AS n FROM documents
      UNION ALL SELECT 'labels', COUNT(*) FROM labels""",
    "write_table": """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(MAX(o_totalprice), 2) AS top
      FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "write_report": f"""{PICKED}, auc AS (
      SELECT model, SUM((n - pos) * (2.0 * tp - pos)) / (2.0 * MAX(tot_pos) * MAX(tot_neg)) AS a,
             CAST(MAX(tot_pos) + MAX(tot_neg) AS BIGINT) AS n FROM curve GROUP BY model)
      SELECT model, ROUND(a::DOUBLE, 6) AS oof_auc, n, threshold_name, {_finite('threshold', 'threshold')}
      FROM picks JOIN auc USING (model)""",
    "training_columns": f"""SELECT name, (SELECT COUNT(*) FROM documents) AS n_rows,
      CAST(position AS INTEGER) AS position, input
      FROM (VALUES ('meta', 0, 'lang'), ('meta', 1, 'source'), ('text', 0, 'n_chars'), ('text', 1, 'n_len'),
        ('text', 2, 'n_digits'), ('text', 3, 'n_lines'), ('text', 4, 'n_spaces')) t(name, position, input)
      UNION ALL SELECT 'vector', (SELECT COUNT(*) FROM embeddings), CAST(i AS INTEGER), 'v:' || i
      FROM range(0, 64) r(i)""",
    "normalize_id": f"""SELECT '  ' || doc_id || ' ' AS raw, CAST(doc_id AS VARCHAR) AS id FROM documents
      UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM documents
      UNION ALL SELECT LPAD(CAST(vec_id AS VARCHAR), 7, '0'), CAST(vec_id AS VARCHAR) FROM embeddings
      UNION ALL SELECT {_PAD}, CAST(doc_id AS VARCHAR) FROM documents""",
    "cohort_filter_train": f"""SELECT CAST(doc_id AS VARCHAR) AS subject_id, toxic AS y_true FROM {_TOXIC}
      WHERE lang IN ({_POPS}) AND source IN ({_GROUPS}) AND toxic IS NOT NULL""",
    "cohort_filter_score": f"""SELECT CAST(doc_id AS VARCHAR) AS subject_id, toxic AS y_true FROM {_TOXIC}
      WHERE lang IN ({_POPS}) AND source IN ({_GROUPS})""",
    "select_unlabelled": _union(
        [
            f"SELECT '{kind}' AS kind, {_PAD} AS subject_id FROM {_TOXIC} WHERE {cond}"
            for kind, cond in (
                ("number", "toxic IS NULL"),
                ("text", "toxic IS NULL"),
                ("half", "toxic IS NULL"),
                ("spelled", "TRUE"),
                ("absent", "TRUE"),
            )
        ]
    ),
    "select_modality_columns": """SELECT 'meta' AS name, CAST(doc_id AS VARCHAR) AS subject_id, 2 AS n_columns FROM documents
      UNION ALL SELECT 'text', CAST(doc_id AS VARCHAR), 5 FROM documents
      UNION ALL SELECT 'vector', CAST(vec_id AS VARCHAR), 64 FROM embeddings""",
    "dedup_keep_first": f"""WITH l AS (SELECT * REPLACE (STRFTIME(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem)
      SELECT * EXCLUDE r FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS r FROM l) WHERE r = 1""",
    "finite_filter": f"WITH {ODD_SQL} SELECT l_orderkey, y_true, ROUND(p, 6) AS p FROM clean",
    "coerce_numeric": """SELECT o_orderkey, ROUND(CASE o_orderstatus WHEN 'F' THEN TRY_CAST(o_orderpriority AS DOUBLE)
      WHEN 'P' THEN o_totalprice ELSE TRY_CAST(SUBSTRING(o_orderpriority, 1, 1) AS DOUBLE) END, 6) AS value FROM orders""",
    "clip_probability": """SELECT l_orderkey, ROUND(LEAST(GREATEST(p, 0.01), 0.99), 6) AS clipped, ROUND(p, 6) AS same,
      ROUND(LEAST(GREATEST(p, 0), 1), 6) AS unit FROM (SELECT l_orderkey, l_discount * 11 - 0.05 AS p FROM lineitem)""",
    "format_subject_id": """SELECT o_orderkey, SUBSTRING(f, 1, 2) || '-' || SUBSTRING(f, 4) AS shown FROM (
      SELECT o_orderkey, REPEAT('0', GREATEST(7 - LENGTH(t), 0)) || t AS f FROM (
        SELECT o_orderkey, CAST(o_orderkey * 997 AS VARCHAR) AS t FROM orders))""",
    "clean_feature_name": """WITH raw AS (
      SELECT p_partkey, p_brand, ['num__', 'cat__', 'remainder__', 'num__cat__', ''][p_partkey % 5 + 1] || p_name
             || CASE WHEN p_size > 25 THEN ' EU' ELSE '' END AS f FROM part)
      SELECT p_partkey, REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(
               f, '^num__', ''), '^cat__', ''), '^remainder__', ''), ' EU$', '') AS stripped,
             TRIM(REGEXP_REPLACE(REGEXP_REPLACE(f, '^num__', ''), '\\s+EU$', '')) AS cleaned,
             UPPER(SUBSTRING(LOWER(p_brand), 1, 1)) || SUBSTRING(LOWER(p_brand), 2) AS meta FROM raw""",
    "join_intersection": f"""WITH {TEXT_SQL}, {LABELS_SQL} SELECT subject_id, lang, source, texts.n_chars, n_len, n_digits,
      n_lines, n_spaces, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS v0, ROUND(CAST(embedding[64] AS DOUBLE), 6) AS v63,
      y_true FROM labelled JOIN texts USING (subject_id)
      JOIN documents d ON CAST(d.doc_id AS VARCHAR) = subject_id
      JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = subject_id""",
    "join_anti_holdout": f"""WITH {TEXT_SQL}, {LABELS_SQL}, {FOLDED_SQL} SELECT texts.*, y_true FROM texts
      JOIN folded USING (subject_id) WHERE fold_id NOT IN (1, 2)""",
    "join_semi_holdout": f"""WITH {TEXT_SQL}, {LABELS_SQL}, {FOLDED_SQL} SELECT texts.*, y_true FROM texts
      JOIN folded USING (subject_id) WHERE fold_id IN (1, 2)""",
    "join_probability_lookup": """WITH last AS (SELECT user_id, value, ROW_NUMBER() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
      SELECT CAST(c_custkey AS VARCHAR) AS subject_id, ROUND(value / 1000, 6) AS p_events
      FROM customer LEFT JOIN last ON user_id = c_custkey AND r = 1""",
    "guard_complete": """SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE toxic IS NULL OR vec_id IS NULL) AS n_incomplete
      FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY lang""",
    "split_feature_types": _union(
        [
            f"SELECT '{t}' AS name, '{c}' AS feature, '{k}' AS kind, COUNT({c}) AS n FROM {t}"
            for t, c, k in (
                ("documents", "doc_id", "numeric"), ("documents", "text", "categorical"),
                ("documents", "lang", "categorical"), ("documents", "source", "categorical"),
                ("documents", "n_chars", "numeric"), ("embeddings", "vec_id", "numeric"),
                ("embeddings", "label", "numeric"), ("customer", "c_custkey", "numeric"),
                ("customer", "c_name", "categorical"), ("customer", "c_nationkey", "numeric"),
                ("customer", "c_acctbal", "numeric"), ("customer", "c_mktsegment", "categorical"),
            )
        ]
    ),
    "one_hot": """SELECT CAST(doc_id AS VARCHAR) AS subject_id, CAST(n_chars AS DOUBLE) AS n_chars,
      CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS lang_en,
      CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END::DOUBLE AS lang_fr FROM documents""",
    "assemble_features": f"""WITH {TEXT_SQL} SELECT subject_id, 5 AS size, CAST(n_chars AS DOUBLE) AS first,
      CAST(n_spaces AS DOUBLE) AS last FROM texts""",
    "early_fusion": f"""WITH {TEXT_SQL}, {LABELS_SQL} SELECT subject_id, y_true, ROUND(
      n_chars + n_len + n_digits + n_lines + n_spaces + 2 + LIST_SUM(CAST(embedding AS DOUBLE[])), 4) AS total
      FROM labelled JOIN texts USING (subject_id) JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = subject_id""",
    "early_fusion_packed": f"""WITH {TEXT_SQL}, {LABELS_SQL}, met AS (
        SELECT subject_id, y_true, texts.* EXCLUDE (subject_id), embedding FROM labelled JOIN texts USING (subject_id)
        JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = subject_id)
      SELECT subject_id, y_true, 'v:' || i AS slot, CAST(embedding[i + 1] AS DOUBLE) AS value FROM met, range(0, 64) r(i)
      UNION ALL """
    + _union([f"SELECT subject_id, y_true, '{c}', CAST({c} AS DOUBLE) FROM met" for c in TEXT_COLUMNS]),
    "pack_wide_source": """SELECT CAST(vec_id AS VARCHAR) AS subject_id, 'v:' || i AS slot,
      CAST(embedding[i + 1] AS DOUBLE) AS value, CAST(63 - i AS INTEGER) AS slot_number FROM embeddings, range(0, 64) r(i)""",
    "hashed_levels": """SELECT CAST(o_custkey AS VARCHAR) AS level, COUNT(*) AS n, CAST(1 AS BIGINT) AS n_slots,
      COUNT(*) AS n_ones FROM orders GROUP BY 1""",
    "align_to_model": f"""WITH {TEXT_SQL} SELECT subject_id, CAST(n_spaces AS DOUBLE) AS n_spaces, TRUE AS missing,
      CAST(n_chars AS DOUBLE) AS n_chars, '__null__' AS lang FROM texts""",
    "balanced_weights": f"""WITH {LABELS_SQL} SELECT subject_id, y_true, ROUND(COUNT(*) OVER () /
      (2.0 * COUNT(*) OVER (PARTITION BY y_true)), 6)::DOUBLE AS weight FROM labelled""",
    "stratified_folds": f"WITH {LABELS_SQL}, {FOLDED_SQL} SELECT * FROM folded",
    "nested_folds": f"WITH {LABELS_SQL}, {FOLDED_SQL}, {NESTED_SQL} SELECT * FROM nested",
    "fold_replay": f"""WITH {LABELS_SQL}, {FOLDED_SQL} SELECT fold_id, COUNT(*) AS n,
      CAST(SUM(y_true) AS BIGINT) AS n_pos FROM folded GROUP BY fold_id""",
    "derive_seed": f"WITH {LABELS_SQL}, {FOLDED_SQL}, {NESTED_SQL} {_seed_sql()}",
    "sample_rows": f"""WITH {TEXT_SQL} SELECT * FROM texts
      ORDER BY MD5('7|' || subject_id), subject_id LIMIT 100""",
    "modal_best_params": """SELECT o_orderpriority AS params, COUNT(*) AS n_folds, MIN(o_orderkey) AS first_fold
      FROM orders GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 1""",
    "assemble_oof": f"""WITH {TEXT_SQL}, {LABELS_SQL}, {FOLDED_SQL} SELECT subject_id, fold_id, y_true,
      ROUND(LEAST(n_chars / 20000, 1.0), 6)::DOUBLE AS proba_chars,
      ROUND(n_spaces / (n_len + 1), 6)::DOUBLE AS proba_spaces FROM folded JOIN texts USING (subject_id)""",
    "average_attribution": """SELECT feature, ROUND(SUM(m) / 5, 6) AS mean_abs FROM (
        SELECT event_id % 5 + 1 AS fold_id, event_type AS feature, AVG(ABS(value)) AS m FROM events
        WHERE NOT (event_id % 5 + 1 = 1 AND event_type = 'click') GROUP BY 1, 2) GROUP BY feature""",
    "top_features": """SELECT p_name || ' ' || p_partkey AS feature, ROUND(p_retailprice, 6) AS mean_abs FROM part
      WHERE p_size % 7 <> 0 ORDER BY p_retailprice DESC, feature LIMIT 20""",
    "linear_attribution": f"""WITH {SCORES_SQL}, means AS (SELECT model, AVG(p) AS mu FROM scores GROUP BY model),
      coefs(model, b) AS (VALUES ('disc', 0.8::DOUBLE), ('qty', -1.2::DOUBLE), ('price', 2.0::DOUBLE))
      SELECT model AS feature, ROUND(AVG(ABS(b * (p - mu))), 6) AS mean_abs
      FROM scores JOIN means USING (model) JOIN coefs USING (model) GROUP BY model""",
    "binary_flags": f"""{PICKED}, t AS (
      SELECT CASE model WHEN 'disc' THEN 'multi_early' ELSE 'multi_late' END AS target, threshold_name, threshold
      FROM picks WHERE model IN ('disc', 'qty'))
      SELECT PRINTF('binary_%s_%s_thr_%.2f', target, threshold_name, threshold) AS flag, COUNT(*) FILTER (
        WHERE CASE target WHEN 'multi_early' THEN CASE WHEN y_true = 1 THEN disc END ELSE qty END >= threshold) AS n_yes
      FROM t, lines GROUP BY target, threshold_name, threshold""",
    "apply_calibrator": f"""WITH {SCORES_SQL} SELECT model, y_true, ROUND(AVG(c), 6) AS mean_cal,
      ROUND(MIN(c), 6) AS min_cal, ROUND(MAX(c), 6) AS max_cal, COUNT(*) AS n
      FROM (SELECT *, 1 / (1 + EXP(-({PLATT_A} * p + {PLATT_B})))::DOUBLE AS c FROM scores) GROUP BY model, y_true""",
    "fit_isotonic": _isotonic_sql(),
    "apply_calibrator_isotonic": _apply_isotonic_sql(),
    "calibrator_meta": f"""WITH {ODD_SQL} SELECT COUNT(*) AS n_oof, CAST(SUM(y_true) AS BIGINT) AS n_pos,
      ROUND(AVG(y_true), 6) AS prevalence, 'sigmoid' AS method, ROUND(1e-6::DOUBLE, 6) AS clip FROM clean""",
    "guard_two_classes": """SELECT l_linestatus || '_' || CAST(TRUNC(l_tax * 100) AS INTEGER) AS model,
      COUNT(DISTINCT CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) = 2 AS both_classes
      FROM lineitem GROUP BY 1""",
}
ORACLES["join_label"] = f"""WITH {TEXT_SQL}, p AS ({ORACLES['cohort_filter_train']})
  SELECT texts.*, y_true FROM texts JOIN p USING (subject_id)"""
