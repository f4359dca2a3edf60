"""Cohorts: label filters, source columns, joins on the subject id, completeness checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import col, is_finite, is_unlabelled, normalize_id

ID, LABEL = "subject_id", "y_true"
EXAMPLES = 10

# The shipped study set-up. Every one is a parameter below.
SEROLOGY_COLUMNS = ["ANCA EU", "CBir1 EU", "OmpC EU", "IgA ASCA EU", "IgG ASCA EU"]
CLINICAL_COLUMNS = [
    "Gender_Self", "Jewish_Self", "Diagnosis", "AgeDx", "Smoking", "FamilyHistory",
    "extent_UC", "Surgery", "upper_GI", "disease_location_CD", "behavior_CD", "Perianal",
]
GENETICS_MARK = ":"
POPULATIONS = ("White",)
DIAGNOSES = ("CD", "UC")


@dataclass(frozen=True)
class Source:
    """A named feature table and the rule for its columns.

    ``rule`` is a list of names, a text every name must contain, or ``None`` for every
    column but the id.
    """

    name: str
    frame: DataFrame
    rule: Sequence[str] | str | None = None


def feature_columns(
    df: DataFrame, rule: Sequence[str] | str | None, id_col: str = ID, strict: bool = True
) -> list[str]:
    """Columns a rule selects. ``strict=False`` tolerates absent fixed names, not none at all."""
    if rule is None:
        found = [c for c in df.columns if c != id_col]
    elif isinstance(rule, str):
        found = [c for c in df.columns if c != id_col and rule in c]
    else:
        missing = [c for c in rule if c not in df.columns]
        if missing and strict:
            raise ValueError(f"missing feature columns {missing}")
        found = [c for c in rule if c not in missing]
    if not found:
        raise ValueError(f"no usable feature columns for rule {rule!r}")
    return found


def select_source(source: Source, id_col: str = ID, strict: bool = True) -> DataFrame:
    """Normalized id and the columns of the source."""
    names = feature_columns(source.frame, source.rule, id_col, strict)
    return source.frame.select(normalize_id(col(id_col)).alias(ID), *[col(c) for c in names])


def whole_label(label: Column) -> Column:
    """The label as an integer; -1, which :func:`guard_labels` refuses, where it has a fraction."""
    return F.when(label == F.floor(label), label.cast("int")).when(label.isNotNull(), -1)


def filter_training(
    pheno: DataFrame,
    population: str,
    populations: Sequence[str],
    group: str,
    groups: Sequence[str],
    label: str,
    id_col: str = ID,
) -> DataFrame:
    """Id and label of the rows in the given populations and groups with a label."""
    return pheno.filter(
        col(population).isin(*populations) & col(group).isin(*groups) & col(label).isNotNull()
    ).select(normalize_id(col(id_col)).alias(ID), whole_label(col(label)).alias(LABEL))


def filter_scoring(
    pheno: DataFrame,
    population: str,
    populations: Sequence[str],
    group: str,
    groups: Sequence[str],
    label: str,
    id_col: str = ID,
) -> DataFrame:
    """Like the training filter, but group and label columns may be absent and labels null."""
    kept = pheno.filter(col(population).isin(*populations))
    if group in pheno.columns:
        kept = kept.filter(col(group).isin(*groups))
    label_cols = [col(label).alias(LABEL)] if label in pheno.columns else []
    return kept.select(normalize_id(col(id_col)).alias(ID), *label_cols)


def select_unlabelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.filter(is_unlabelled(df, label))


def dedup_keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the first by ``order``, then by the remaining columns.

    A minimum over structs combines map-side, so a key with very many copies sends one
    row per task instead of filling one task with a window.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    lead = [c for c in order if c in rest]
    ranked = [*lead, *[c for c in rest if c not in lead]]
    first = df.groupBy(*[col(k) for k in keys]).agg(
        F.min(F.struct(*[col(c) for c in ranked])).alias("_row")
    )
    return first.select(*[col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def join_label(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Expanded cohort: every labelled row of one source; duplicates multiply."""
    return features.join(labels, ID, "inner")


def join_intersection(
    features: Mapping[str, DataFrame],
    labels: DataFrame | None = None,
    dedup: bool = True,
    order: Sequence[str] = (),
) -> DataFrame:
    """Wide cohort of the subjects present in every source (and labelled, if labels are given).

    De-duplicating each side first gives the first row of the join without ever building
    the product of the copies. All joins share one hash partitioning on the id.
    """
    sides = [*features.values(), *([labels] if labels is not None else [])]
    if dedup:
        sides = [dedup_keep_first(s, [ID], order) for s in sides]
    return reduce(lambda a, b: a.join(b, ID, "inner"), sides)


def without_ids(df: DataFrame, *holdouts: DataFrame) -> DataFrame:
    """Rows whose id is in none of the hold-out sets."""
    return df.join(_ids(holdouts), ID, "left_anti")


def only_ids(df: DataFrame, *holdouts: DataFrame) -> DataFrame:
    """Rows whose id is in some hold-out set."""
    return df.join(_ids(holdouts), ID, "left_semi")


def _ids(holdouts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [h.select(ID) for h in holdouts]).distinct()


def join_probability(
    rows: DataFrame, probabilities: DataFrame, name: str, order: Sequence[str] = ()
) -> DataFrame:
    """Attach ``p`` by id as column ``name``; the last of duplicate ids wins."""
    last = probabilities.groupBy(normalize_id(F.col(ID)).alias(ID)).agg(
        F.max(F.struct(*order, "p")).getField("p").alias(name)
    )
    return rows.join(last, ID, "left")


def completeness(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, and rows with a null or non-finite value in some of the columns."""
    bad = reduce(lambda a, b: a | b, [~is_finite(col(c)) for c in columns])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_incomplete")
    )


def guard_complete(
    df: DataFrame, columns: Sequence[str], what: str, id_col: str = ID
) -> DataFrame:
    """``df`` itself, or an error for an empty frame or incomplete rows (up to ten ids)."""
    n, n_bad = completeness(df, columns).first()
    if n == 0:
        raise ValueError(f"{what}: no rows")
    if n_bad:
        bad = reduce(lambda a, b: a | b, [~is_finite(col(c)) for c in columns])
        ids = [r[0] for r in df.filter(bad).select(id_col).limit(EXAMPLES).collect()]
        raise ValueError(f"{what}: {n_bad} of {n} rows incomplete, for example {ids}")
    return df


def guard_labels(df: DataFrame, what: str, label: str = LABEL) -> DataFrame:
    """``df`` itself, or an error unless it has rows, all labelled 0 or 1."""
    n, n_bad = df.agg(
        F.count(F.lit(1)), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))
    ).first()
    if n == 0:
        raise ValueError(f"{what}: no rows")
    if n_bad:
        raise ValueError(f"{what}: {n_bad} of {n} labels are not 0 or 1")
    return df
