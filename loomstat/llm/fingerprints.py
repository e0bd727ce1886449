"""Document fingerprints: bottom-k sketches of shingle hashes (operator 11, built-in functions only).

A text's shingles are its runs of five words in lower case (a shorter text has
its whole sequence as one). Each is hashed to 52 bits, and the ``k`` smallest
distinct hashes are the sketch. The sketch of a union of parts is the ``k``
smallest of the parts' sketches together, so sketches merge in any order. The
``k`` smallest of two sketches together are a uniform sample of the union of
both sets: its share found in both estimates their resemblance, and how far it
reaches into the range of hashes estimates the union's size, hence containment
and the number of distinct shingles. Sets of at most ``k`` shingles are compared
exactly.

Texts are paired with their successors by id without a window over all rows:
the rows are cut into ranges of ids of bounded size, whose bounds are known
before any text moves, so the first row of a range also travels to the range
before it. Every text is shuffled once.

Defined results: a null text counts as empty; two sets without shingles have
likeness 1, one without and one with have 0; null ids come first, equal ids in
order of a text hash; after the last document comes the first, which may be
itself; an empty table gives no rows; other columns are ignored. Rows equal in
id and text share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import parallelism, stored

WIDTH = 5
#: Hashes of a sketch: the standard error of a likeness is below 1 / (2 sqrt(K)).
K = 128
#: A hash has 13 hexadecimal digits.
RANGE = 1 << 52
#: Bytes of text in a range of ids, and the most ranges there are (beyond which they grow).
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 18
NUMBERS = "array<bigint>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def hash_of(shingle: Column) -> Column:
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 13), 16, 10).cast("long")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """A hash per shingle, in order, repeats kept."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: hash_of(F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast(NUMBERS))

    # the lambda binds the words once
    return F.element_at(F.transform(F.array(words(F.coalesce(text, F.lit("")))), of), 1)


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The ``k`` smallest distinct shingle hashes of a text, ascending."""
    return least(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else estimated from the largest hash kept."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / ((F.element_at(s, -1) + 1) / F.lit(float(RANGE))))


def _shared(a: Column, b: Column, both: Column) -> Column:
    return F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(both, -1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity of two sets, from their sketches."""
    def of(both: Column) -> Column:
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(_shared(a, b, both) / F.size(both))

    return F.element_at(F.transform(F.array(merge(a, b, k)), of), 1)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of set ``a`` that lies in set ``b``, from their sketches; 1 for an empty ``a``."""
    def of(both: Column) -> Column:
        common = _shared(a, b, both) / F.size(both) * distinct_count(both, k)
        return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))

    return F.element_at(F.transform(F.array(merge(a, b, k)), of), 1)


def merged(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of rows, such as the parts of a document or the documents of a source.

    Repeated hashes meet first, spread over all tasks; then every task keeps
    its ``k`` smallest of each group before the shuffle, so that a hot group
    moves few rows. Groups without hashes have an empty sketch.
    """
    smallest = Window.partitionBy(*keys).orderBy("__hash")
    found = (
        df.select(*keys, F.explode(sketch_col).alias("__hash")).distinct()
        .withColumn("__place", F.row_number().over(smallest)).where(F.col("__place") <= k)
        .groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias("__sketch"))
    )
    groups = df.select(*keys).distinct()
    on = [groups[c].eqNullSafe(found[c]) for c in keys]
    return groups.join(found, on, "left").select(*[groups[c] for c in keys], F.coalesce("__sketch", F.array().cast(NUMBERS)).alias(sketch_col))


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The first key of each range of about equal numbers of rows."""
    cut = keys.repartitionByRange(ranges, "id", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "h")).alias("low"))
    return sorted((r.low.id, r.low.h) for r in cut.collect())


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(NUMBERS)


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Place of the last bound not above the row's key, by halving steps."""
    ids, hs = (_numbers([b[k] for b in bounds]) for k in (0, 1))
    halves = [1 << n for n in range((len(bounds) - 1).bit_length() - 1, -1, -1)] or [1]

    def move(at: Column, step: Column) -> Column:
        i, h = F.get(ids, at + step), F.get(hs, at + step)
        return F.when((i < F.col("id")) | ((i == F.col("id")) & (h <= F.col("h"))), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in halves]), F.lit(0), move)


def with_next(df: DataFrame, id_col: str, text_col: str, extra: dict[str, Column] | None = None,
              range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, text`` and ``extra`` columns of every row with ``next``, a struct of the following row's text and extras."""
    # null ids share the lowest number for the order, the text hash tells them from real ones
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64("text").alias("h"))
    keys = stored(rows.select("id", "h", F.octet_length("text").alias("bytes")), "fingerprint-keys")
    tasks = parallelism(df.sparkSession)
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    bounds = _bounds(keys.select("id", "h"), min(MOST_RANGES, max(8 * tasks, size // range_bytes))) or [(0, 0)]
    n = len(bounds)
    lows = F.array(F.get(_numbers([b[0] for b in bounds]), F.col("at")), F.get(_numbers([b[1] for b in bounds]), F.col("at")))
    placed = rows.withColumn("at", _range_of(bounds) if n > 1 else F.lit(0)).withColumn("first", lows == F.array("id", "h"))
    here, before = F.struct("at", F.lit(False).alias("guest")), F.struct(((F.col("at") + (n - 1)) % n).alias("at"), F.lit(True).alias("guest"))
    dealt = (
        placed.select("doc_id", "text", "id", "h", F.explode(F.when(F.col("first"), F.array(here, before)).otherwise(F.array(here))).alias("to"))
        .select("doc_id", "text", "id", "h", "to.at", "to.guest").repartition(max(tasks, n // 8), "at")
        .withColumns(extra or {})
    )
    names = ["text", *(extra or {})]
    following = F.lead(F.struct(*names)).over(Window.partitionBy("at").orderBy("guest", "id", "h"))
    return dealt.withColumn("next", following).where(~F.col("guest")).select("doc_id", *names, "next")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sketches of every text and of its edited form, whose second half is the
    beginning of the next document, with their likeness.

    ``fingerprint`` and ``edited_fingerprint`` are the hashes in ascending
    order, joined by commas.
    """
    half = F.expr("n_chars div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half))
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return (
        with_next(df, id_col, text_col, {"own": sketch(F.col("text"), k, width)}, range_bytes)
        .withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
        .select("doc_id", "n_chars", "own", F.col("next.own").alias("after"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                sketch(F.col("edited"), k, width).alias("changed"))
        .select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", as_text("own").alias("fingerprint"),
                as_text("changed").alias("edited_fingerprint"), resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
                resemblance(F.col("own"), F.col("after"), k).alias("near_next"))
    )
