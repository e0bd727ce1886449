"""Mixing sources to target weights by hash-threshold histograms (operator 3).

A source's target is a number of words. Its documents are taken whole
``floor(target / size)`` times, and the rest of the target is met by the
documents whose id hash lies below a threshold. The threshold is found without
sorting: words are summed by source and hash bucket, the bucket where the
budget ends is found from these few sums, and only that bucket is divided
again, until it holds one hash value. Thresholds of growing targets are nested:
a larger target keeps what a smaller one took. The choice depends on ids and
sizes alone, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; documents of one id share their fate, as they share the hash; a
source without words has target 0; an empty table gives no rows. The boundary
document is taken when that comes nearer to the target. ``apply`` keeps
all columns, whatever their names. One row per source passes a single task
(the ranking of the sources); nothing else does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: The hash has 60 bits, of which each pass looks at ten more.
HASH_BITS, STEP_BITS = 60, 10


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id_col: Column) -> Column:
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Shares of the total go by weight (repeating over the sources in order of
    their names); what exceeds ``cap`` times a source's size is shared again
    among the others. That ends at ``target = min(cap, weight * level)`` with
    one level for all, found by filling the sources in order of cap per weight.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", "place")
    place = F.row_number().over(named)
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), ((place - 1) % len(weights)).cast("int")).cast("long")
    level = (F.col("total") - F.col("before")) / F.col("left_weight")
    return (
        sizes.withColumns({"place": place, "weight": weight, "most": F.col("source_size") * cap})
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumns({
            "total": F.sum("source_size").over(Window.partitionBy()),
            "before": F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"),
            "left_weight": F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)),
        })
        .withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "place", level.alias("level"))))
                    .over(Window.partitionBy())["level"])
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def thresholds(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per source ``source, source_size, target, copies, below``: its documents
    are taken ``copies`` times, those with a hash under ``below`` once more.

    ``sized`` holds ``source, size, h``.
    """
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = targets(sizes, weights, cap).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # The boundary bucket [lo, lo + width) holds `words`, of which the budget covers `spare`; `open` while it has several hashes.
    plan = stored(plan.withColumns({
        "lo": F.lit(0).cast("long"), "width": F.lit(1 << HASH_BITS), "words": F.col("source_size"),
        "spare": F.col("target") - F.col("copies") * F.col("source_size"), "open": F.lit(True)}), "mix-plan")
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        if not plan.where("open").limit(1).count():
            break
        step = 1 << (HASH_BITS - bits)
        edges = plan.where("open").select(F.col("source").alias("s"), F.col("lo").alias("from"), "width", F.col("spare").alias("budget"))
        inside = sized.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("from"))
                            & (F.col("h") < F.col("from") + F.col("width")))
        sums = inside.groupBy("s", "budget", F.expr(f"from + ((h - from) div {step}L) * {step}L").alias("at")).agg(
            F.sum("size").alias("w"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        order = Window.partitionBy("s").orderBy("at")  # at most 1,024 buckets a source
        edge = (
            sums.withColumn("cum", F.sum("w").over(order)).where(F.col("cum") > F.col("budget"))
            .groupBy("s").agg(F.min_by(F.struct("at", "w", "cum", "budget", "h0", "h1"), "at").alias("e"))
            .select("s", F.col("e.at").alias("e_lo"), F.col("e.w").alias("e_words"),
                    (F.col("e.budget") - (F.col("e.cum") - F.col("e.w"))).alias("e_spare"),
                    (F.col("e.h0") < F.col("e.h1")).alias("e_open"))
        )
        hit = F.col("e_lo").isNotNull()
        now = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
        plan = stored(
            plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "copies", now("e_lo", "lo"),
                F.when(hit, F.lit(step)).otherwise(F.col("width")).alias("width"), now("e_words", "words"), now("e_spare", "spare"),
                F.coalesce("e_open", F.lit(False)).alias("open")), "mix-plan")
    return plan.select(
        "source", "source_size", "target", "copies",
        F.when(2 * F.col("spare") > F.col("words"), F.col("lo") + F.col("width")).otherwise(F.col("lo")).alias("below"))


def times(h: Column) -> Column:
    """How often a document is taken, given its source's row of ``thresholds``."""
    return F.col("copies") + F.when(h < F.col("below"), 1).otherwise(0)


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row."""
    sized = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), size_of(F.col(text_col)).alias("size"))
                   .withColumn("h", hash_of(F.col("id"))), "mix-sizes")
    plan = thresholds(sized.select(F.col("src").alias("source"), "size", "h"), weights, cap)
    return (
        sized.join(plan, F.col("src").eqNullSafe(F.col("source")), "left")
        .select(F.col("id").alias(id_col), F.col("src").alias(source_col), "size", "source_size", "target",
                (F.col("size") * times(F.col("h"))).alias("taken"))
    )


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken."""
    sized = stored(df.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"),
                             hash_of(F.col(id_col)).alias("h")), "mix-sizes")
    plan = thresholds(sized, weights, cap).select(F.col("source").alias("__src"), "copies", "below")
    plan = plan.withColumnsRenamed({"copies": "__copies", "below": "__below"})
    h = hash_of(F.col(id_col))
    n = F.col("__copies") + F.when(h < F.col("__below"), 1).otherwise(0)
    return (
        df.join(plan, F.col(source_col).eqNullSafe(F.col("__src")))
        .withColumn("__each", F.explode(F.array_repeat(F.lit(True), n.cast("int"))))
        .select(*df.columns)
    )
