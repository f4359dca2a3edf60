"""Document fingerprints: the ``k`` least hashes of a text's word shingles.

Words are runs without white space, in lower case; a shingle is ``shingle`` words, and a text
with fewer words is one shingle. A fingerprint is the sorted list of the ``k`` least
distinct 64-bit hashes, so equal texts have equal fingerprints and the fingerprint of a union
comes from the fingerprints of its parts. From two of them follow resemblance (shared part of
the least hashes of the union), containment and the number of distinct shingles.

A null text counts as empty; empty fingerprints are alike (1), an empty and another one are
not (0). Very long texts are one array of words at a time. Extra columns are kept where
rows are kept; added columns replace those of the same names. Equal rows stay.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.tables import let

K = 128
SHINGLE = 5
SPREAD = 8
EDGE_ACCURACY = 100


def fingerprint(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array of the ``k`` least shingle hashes (signed order)."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\r\x0b\x0c"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))

    def shingles(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - shingle, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(shingle)]),
        )

    def least(hashes: Column) -> Column:
        none = F.array().cast("array<bigint>")
        all_of = F.when(F.size(hashes) == 0, none).otherwise(shingles(hashes))
        return F.slice(F.sort_array(F.array_distinct(all_of)), 1, k)

    return let(F.transform(words, lambda w: F.xxhash64(w)), least)


def as_text(fp: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(fp, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def united(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both; exact if the union has at most ``k``."""
    both = let(
        united(a, b, k),
        lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u),
    )
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both)


def distinct_shingles(fp: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th hash."""
    place = (F.element_at(fp, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(fp) < k, F.size(fp).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; an empty ``a`` is contained."""
    shared = resemblance(a, b, k) * distinct_shingles(united(a, b, k), k)
    share = F.least(F.lit(1.0), shared / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


def merged(parts: DataFrame, by: list[str], fp: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for all parts with equal ``by``: the ``k`` least hashes of all.

    Equal hashes of a group combine first, by group and hash; the rank filter then keeps
    ``k`` rows of a group in each task before the shuffle, so a group of any size fits.
    """
    each = parts.select(*by, F.explode_outer(fp).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))
    kept = each.withColumn("_r", rank).filter(F.col("_r") <= k)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(fp))


def range_starts(rows: DataFrame, key: Column, width: int) -> list[float]:
    """Greatest keys of about ``width`` ranges of equal size, from the greatest down.

    They occur as keys; a sketch of the keys finds them.
    """
    steps = [i / width for i in range(1, width)] or [0.5]
    cuts, top = rows.agg(
        F.percentile_approx(key, steps, width * EDGE_ACCURACY), F.max(key)
    ).first()
    return sorted({*(cuts or []), top if top is not None else 0.0}, reverse=True)


def with_range(rows: DataFrame, key: Column, starts: list[float], name: str) -> DataFrame:
    """Adds the number of each row's range; range 0 has the greatest keys."""
    splits = [-float("inf"), *(-e for e in starts[1:]), float("inf")]
    if len(splits) < 3:
        return rows.withColumn(name, F.lit(0))
    turned = rows.withColumn("_minus", -key)
    found = Bucketizer(splits=splits, inputCol="_minus", outputCol=name).transform(turned)
    return found.withColumn(name, F.col(name).cast("int")).drop("_minus")


def edit(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first characters of ``following``."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def neighbours(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next text are.

    The next row is the one with the next smaller id (nulls last; equal ids by text), and after
    the last comes the first. Ids are cut into ranges; the row that follows a range is a copy
    of the first row of the next one, so texts are shuffled once and no task sees more
    than a range. Ids must be whole numbers; rows with equal ids share a range.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        order.alias("_long"),
        order.cast("double").alias("_key"),
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SPREAD
    starts = range_starts(rows, F.col("_key"), width)
    rows = with_range(rows, F.col("_key"), starts, "_range")
    first_of = F.get(F.array(*[F.lit(float(e)) for e in starts]), F.col("_range"))
    before = F.pmod(F.col("_range") - 1, F.lit(len(starts)))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("range"), F.lit(1).alias("guest"))
    places = F.when(F.col("_key") == first_of, F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "_long", F.explode(places).alias("_at"))
    dealt = dealt.select("doc_id", "text", "_long", "_at.range", "_at.guest")
    w = Window.partitionBy("range").orderBy("guest", F.desc("_long"), F.desc("doc_id"), "text")
    led = dealt.withColumn("_next", F.lead("text").over(w))
    edited = led.withColumn("edited", edit(F.col("text"), F.coalesce("_next", F.lit("")))).drop("_next")
    made = edited.withColumn("fp", fingerprint(F.col("text"), k, shingle)).withColumn(
        "edited_fp", fingerprint(F.col("edited"), k, shingle)
    )
    both = made.withColumn("next_fp", F.lead("fp").over(w)).filter("guest = 0")
    return both.select(
        "doc_id",
        "text",
        "edited",
        "fp",
        "edited_fp",
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
    )
