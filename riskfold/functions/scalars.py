"""Column expressions: identifiers, probabilities, labels and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results must match these exactly.
WHITESPACE = " \t\n\r\x0b\x0c"
FEATURE_PREFIXES = ("num__", "cat__", "remainder__")
UNIT_SUFFIX = " EU"
DISPLAY_ID_WIDTH = 7


def col(name: str) -> Column:
    """Column by its literal name, whatever characters the name contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_id(c: Column) -> Column:
    """Trimmed id; an all-digit id loses its leading zeros (``"000"`` becomes ``"0"``).

    Works on text, so ids longer than a bigint survive. A null id stays null and
    therefore joins with nothing.
    """
    t = strip(c.cast("string"))
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)


def format_subject_id(c: Column) -> Column:
    """Display id: zero-filled to seven characters, then ``AB-DEFG...``.

    The third character is dropped, so two ids may share one display id: keep the
    real id in a column of its own.
    """
    text = c.cast("string")
    # lpad would also truncate, so longer ids must bypass it.
    filled = F.when(
        F.length(text) < DISPLAY_ID_WIDTH, F.lpad(text, DISPLAY_ID_WIDTH, "0")
    ).otherwise(text)
    return F.concat(F.substring(filled, 1, 2), F.lit("-"), filled.substr(F.lit(4), F.length(filled)))


def coerce_numeric(c: Column) -> Column:
    """Number, or null where the text is not one."""
    return strip(c.cast("string")).try_cast("double")


def is_finite(c: Column) -> Column:
    """True only for a number that is neither null, NaN nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), F.lit(False))


def at_least(p: Column, threshold: Column) -> Column:
    """``p >= threshold`` where null and NaN on either side count as false."""
    p, threshold = p.cast("double"), threshold.cast("double")
    return F.coalesce(
        (p >= threshold) & ~F.isnan(p) & ~F.isnan(threshold), F.lit(False)
    )


def clip_probability(p: Column, eps: float) -> Column:
    """Clamp to ``[eps, 1 - eps]``; ``eps <= 0`` leaves the value alone."""
    if eps <= 0:
        return p
    return clamp(p, eps, 1.0 - eps)


def clamp(p: Column, low: float, high: float) -> Column:
    """Clamp while keeping null null and NaN NaN."""
    p = p.cast("double")
    return F.when(p.isNull() | F.isnan(p), p).otherwise(
        F.least(F.greatest(p, F.lit(low)), F.lit(high))
    )


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, zero where the denominator is zero."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den)


def is_unlabelled(df: DataFrame, label: str) -> Column:
    """True when the row carries no usable 0/1 label.

    Numbers are truncated first (0.5 counts as 0); text must spell an integer, so
    ``"0.5"`` and ``"x"`` are unlabelled.
    """
    if label not in df.columns:
        return F.lit(True)
    value = col(label)
    if isinstance(df.schema[label].dataType, T.StringType):
        value = F.when(strip(value).rlike(r"^[+-]?[0-9]+$"), strip(value).try_cast("decimal(38,0)"))
    else:
        value = value.try_cast("bigint")
    return ~F.coalesce(value.isin(0, 1), F.lit(False))


def strip_feature_name(c: Column) -> Column:
    """Drop each transformer prefix in turn, then the trailing unit."""
    for prefix in FEATURE_PREFIXES:
        c = F.regexp_replace(c, "^" + prefix, "")
    return F.regexp_replace(c, UNIT_SUFFIX + r"\z", "")


def clean_feature_name(c: Column) -> Column:
    """Report form of a feature name."""
    return strip(F.regexp_replace(F.regexp_replace(c, "^num__", ""), r"\s+EU\z", ""))


def meta_feature_name(c: Column) -> Column:
    """Report form of a meta-model input: source name in title case."""
    return F.initcap(F.regexp_replace(c, "^p_", ""))
