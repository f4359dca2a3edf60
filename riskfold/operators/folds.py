"""Reproducible stratified folds, seeds and samples, exact at any number of partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.operators.cohort import ID, LABEL

BUCKET_HEX = 3  # 16**3 even buckets of the md5 space

# Offsets that keep the random streams of a run apart.
SOURCE_SEED = {"lab": 11, "serology": 22, "genetics": 33, "clinical": 44}
STAGE_SEED = {"single": 1000, "early": 2000, "late_inner": 3000, "late_base": 4000}
FINAL_SEED = {"single": 9100, "early": 9200, "late_base": 9300}
INNER_CV_SEED, SEARCH_SEED = 100, 200
ATTRIBUTION_SEED = {"single": 1000, "multi": 2000}
CALIBRATION_SEED = {"early": 7100, "late": 7200, "single": 3000, "deploy": 9999}


def derive_seed(
    stage: str, fold: int | Column = 0, source: str | None = None, inner: int | Column = 0
) -> int | Column:
    """Seed offset of one fit: stage and outer fold, inner fold, source."""
    return STAGE_SEED[stage] * fold + 10 * inner + source_seed(source)


def source_seed(source: str | None) -> int:
    """Listed sources keep their number, others get one from the letters of their name."""
    if source is None:
        return 0
    return SOURCE_SEED.get(source, sum(map(ord, source)) % 1000)


def shuffle_key(seed: int | Column, *cols: str) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") for c in cols]))


def stratified_folds(
    df: DataFrame,
    k: int,
    seed: int | Column,
    id_col: str = ID,
    label: str = LABEL,
    by: Sequence[str] = (),
    name: str = "fold_id",
    tie: Sequence[str] = (),
    few: bool = False,
) -> DataFrame:
    """Number rows 1..k so that per-class counts differ by at most one between folds.

    The order is ``(label, md5(seed|id), id)`` and folds are dealt round-robin. The rank
    is a rank inside even md5 buckets plus the rows in earlier buckets, so one class with
    most of the rows still spreads over thousands of groups. Where ids repeat within
    ``by``, ``tie`` columns join the key: copies of one id scatter and stay reproducible.
    ``few`` says that one task can sort the rows of a ``by`` group: the same ranks, taken at once.
    """
    by = list(by)
    hashed = df.withColumn("_h", shuffle_key(seed, id_col, *tie))
    if few:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(label, "_h", id_col, *tie)) - 1
        dealt = hashed.withColumn(name, (rank % k + 1).cast("int"))
        # As in the join below, a row without a group or label counts but is in no fold.
        for c in [*by, label]:
            dealt = dealt.filter(F.col(c).isNotNull())
        return dealt.select(*df.columns, name)
    keyed = hashed.withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    # One row per class and bucket.
    earlier = Window.partitionBy(*by).orderBy(label, "_b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        keyed.groupBy(*by, label, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, label, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*by, label, "_b").orderBy("_h", id_col, *tie)
    rank = F.row_number().over(inside) + F.col("_before") - 1
    if tie:
        # Shuffled, not sent through the driver: the window needs the rows by class and bucket
        # anyway. Without a tie this would deal copies of one id in another order.
        offsets = offsets.hint("shuffle_hash")
    return (
        keyed.join(offsets, [*by, label, "_b"])
        .withColumn(name, (rank % k + 1).cast("int"))
        .select(*df.columns, name)
    )


def fold_sizes(sizes: Mapping[int, int], k: int) -> dict[tuple[int, int], int]:
    """Rows of each fold and class, both present, as ``stratified_folds`` deals classes of these sizes."""
    out, before = {}, 0
    for label, n in sorted(sizes.items()):
        for fold in range(k):
            dealt = (before + n - fold + k - 1) // k - (before - fold + k - 1) // k
            if dealt:
                out[fold + 1, int(label)] = dealt
        before += n
    return out


def nested_folds(
    df: DataFrame,
    outer: int,
    inner: int,
    seed: int,
    id_col: str = ID,
    label: str = LABEL,
    few: bool = False,
) -> DataFrame:
    """Inner folds of every outer-training set of a frame that has ``fold_id``.

    One row per subject and outer fold it trains in: ``outer_fold`` and ``inner_fold``.
    """
    folds = F.array(*[F.lit(f) for f in range(1, outer + 1)])
    training = df.withColumn(
        "outer_fold", F.explode(F.filter(folds, lambda f: f != F.col("fold_id")))
    )
    return stratified_folds(
        training, inner, F.lit(seed) + F.col("outer_fold"), id_col, label, ["outer_fold"], "inner_fold", few=few
    )


def sample_rows(df: DataFrame, m: int | None, seed: int, id_col: str = ID) -> DataFrame:
    """The ``m`` rows first in the seeded order of their ids; all rows when ``m`` is None."""
    if m is None:
        return df
    return df.orderBy(shuffle_key(seed, id_col), id_col).limit(m)
