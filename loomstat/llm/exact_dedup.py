"""Exact deduplication by two passes over a Bloom filter (operator 1, built-in functions only).

Pass one counts hash slots, eight bytes a row and combined where the rows are,
and puts the slots hit twice into a Bloom filter. Pass two tests every row
against the broadcast filter: rows it clears are certainly unique and pass
straight through; only the others are shuffled and compared by SHA-256.

Defined results: a null text counts as empty; an empty table gives no rows;
rows with the same id and text count as copies of each other, and of those one
stays; a null id ranks below every other. Columns besides id and text are
ignored by ``assign`` and returned unchanged by ``drop_copies``, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm import bloom
from loomstat.llm.common import stored

#: A group over this share of all rows is joined by broadcast: there are at most this many of them.
HOT_SHARE = 1024


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def slot_of(sha: Column) -> Column:
    return F.xxhash64(sha)


@dataclass
class Repeats:
    """What the passes found: the slots hit twice, and the groups of copies."""

    digests: DataFrame
    slots: DataFrame
    n_slots: int
    groups: DataFrame
    hot_rows: int
    max_keys: int

    def marked(self, df: DataFrame, sha: Column, name: str) -> DataFrame:
        return bloom.split(df, slot_of(sha), self.slots, "slot", self.n_slots, name, self.max_keys)

    def with_groups(self, df: DataFrame, sha: str) -> DataFrame:
        """Join the groups on ``sha``. Groups over a fixed share of the rows are
        few whatever the input, so they are broadcast; no other group is large
        enough to make a hot task."""
        g = self.groups.withColumnRenamed("g_sha", "__sha")
        hot, cold = g.where(F.col("group_size") > self.hot_rows), g.where(F.col("group_size") <= self.hot_rows)
        on = F.col(sha) == F.col("__sha")
        first = df.join(F.broadcast(hot), on).drop("__sha")
        rest = df.join(F.broadcast(hot.select("__sha")), on, "left_anti").join(cold, on).drop("__sha")
        return first.unionByName(rest)


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_keys: int = bloom.MAX_KEYS) -> Repeats:
    digests = stored(
        df.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("sha"))
        .withColumn("row", F.monotonically_increasing_id()), "digests")
    slots = stored(
        digests.groupBy(slot_of(F.col("sha")).alias("slot")).agg(F.count("*").alias("n")).where("n > 1").select("slot"), "slots")
    n_slots, n = slots.count(), digests.count()
    maybe = bloom.split(digests, slot_of(F.col("sha")), slots, "slot", n_slots, "maybe", max_keys).where("maybe")
    groups = stored(
        maybe.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
        .select(F.col("sha").alias("g_sha"), F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"),
        "groups")
    return Repeats(digests, slots, n_slots, groups, max(HOT_SHARE, n // HOT_SHARE), max_keys)


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_keys: int = bloom.MAX_KEYS) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays.
    """
    found = find_repeats(df, id_col, text_col, max_keys)
    rows = found.marked(found.digests, F.col("sha"), "maybe")
    alone = rows.where(~F.col("maybe")).select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    grouped = found.with_groups(rows.where("maybe").select("id", "sha", "row"), "sha").select(
        "id", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_keys: int = bloom.MAX_KEYS) -> DataFrame:
    """``df`` without its copies, all columns kept. Rows cleared by the filter
    are not shuffled."""
    found = find_repeats(df, id_col, text_col, max_keys)
    tagged = found.marked(df.withColumn("__text_sha", digest_of(F.col(text_col))), F.col("__text_sha"), "__maybe")
    alone = tagged.where(~F.col("__maybe")).select(*df.columns)
    ids = found.groups.select("g_sha", F.col("keep_id").alias("__keep"), "group_size")
    held = Repeats(found.digests, found.slots, found.n_slots, ids, found.hot_rows, max_keys)
    stay = (
        held.with_groups(tagged.where("__maybe").drop("__maybe"), "__text_sha")
        .where(F.col(id_col).eqNullSafe(F.col("__keep")))
        .dropDuplicates(["__text_sha"])
    )
    return alone.unionByName(stay.select(*df.columns))
