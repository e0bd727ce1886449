"""Substring deduplication by paragraph MinHash banding (operator 4).

Two kinds of paragraph are compared between documents, both on words in lower
case without the marks around them:

* lines of ``LINE_WORDS`` words and more: MinHash bands over five-word shingles,
  tuned so that lines of similarity 0.8 collide with a probability of
  ``RECALL`` or more; colliding lines are verified by their exact Jaccard similarity
  and linked into components;
* passages inside lines: the words of a document are cut where a word pair's
  hash is the smallest within ``REACH`` words, so that a passage copied into
  another document is cut alike there, wherever it begins. Pieces are compared
  whole; they count where a run of repeated pieces has ``RUN_WORDS`` words.

A paragraph found in two or more documents is reported with each of its places.
The place in the smallest document id, first in it, is kept; the others are for
removal. Places are word numbers, from 0, the end exclusive; ``remove`` cuts
them out of the texts.

Defined results: a null text counts as empty and has no paragraph; rows without
id are left alone; paragraphs repeated within one document id only are not
reported; rows equal in id and text share one report; an empty table gives no
rows; other columns are ignored, and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm import bloom
from loomstat.llm.common import hot_join, steps, stored, words_of
from loomstat.llm.jaccard_join import bitmap, cluster, node_of
from loomstat.llm.shingles import mixed, shingle_numbers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_WORDS, WIDTH, PERCENT = 20, 5, 80
RECALL, ROWS = 0.995, 2
REACH, RUN_WORDS = 5, 16
#: Stands for a line's end among the words.
BREAK = "\x1e"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
LINE, PIECE = 0, 1
UNIT_SCHEMA = "id long, hash long, kind int, first int, last int, key long, n long, bits binary, bands array<long>"


def bands_for(percent: int = PERCENT, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima that reach the recall at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the number of each word, and for each word how many lines end before it (over all texts)."""
    marked = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", f" {BREAK} ")
    counts, index, words = words_of(marked)
    names = words.to_pylist()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w.lower().strip(EDGES)) for w in names), np.uint64, len(names))
    ends = (np.array([w == BREAK for w in names], bool)[index]) if len(names) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner[~ends], minlength=len(counts)), each[index][~ends], (np.cumsum(ends) + owner)[~ends]


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line of enough words: its text, first word, number of words; and the words' numbers, line after line."""
    counts, numbers, line = word_rows(texts)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(line)])
    owner = np.searchsorted(np.cumsum(counts), first, side="right")
    long = sizes >= LINE_WORDS
    return owner[long], first[long] - (np.cumsum(counts) - counts)[owner[long]], sizes[long], numbers[np.repeat(long, sizes)]


def line_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted shingle sets of the lines of all texts."""
    _, _, sizes, numbers = lines_of(texts)
    bounds, shingles = shingle_numbers(sizes, numbers, WIDTH)
    return [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every piece between two cuts: its text, first word, number of words and number."""
    counts, numbers, _ = word_rows(texts)
    n = len(numbers)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    owner = np.repeat(np.arange(len(counts)), counts)
    following = np.r_[numbers[1:], np.uint64(0)]
    following[:-1][owner[1:] != owner[:-1]] = 0  # a text's last word knows nothing of the next text
    value = mixed(numbers * np.uint64(3) + following)
    cut = np.ones(n, bool)
    for k in range(1, REACH + 1):
        same = owner[k:] == owner[:-k]
        cut[k:] &= ~same | (value[k:] < value[:-k])
        cut[:-k] &= ~same | (value[:-k] <= value[k:])
        cut[k:] &= same  # too near to the beginning of the text to know
        cut[:k] = False
    at = np.flatnonzero(cut)
    begin, end = at[:-1], at[1:]
    whole = owner[begin] == owner[end]
    begin, end = begin[whole], end[whole]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sizes = end - begin
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = mixed(numbers[np.repeat(begin, sizes) + place] + mixed(place.astype(np.uint64) + np.uint64(1)))
    key = np.add.reduceat(words, np.cumsum(sizes) - sizes)
    return owner[begin], begin - (np.cumsum(counts) - counts)[owner[begin]], sizes, key


def units(texts: DataFrame) -> DataFrame:
    """Every line and piece of ``texts (id, text)``; lines with their set's size, bitmap and bands."""
    bands = bands_for()
    factors = mixed(np.arange(1, bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                ids, hashes = (part.column(c).to_numpy() for c in ("id", "hash"))
                owner, first, sizes, _ = lines_of(part.column("text"))
                sets = line_sets(part.column("text"))
                if sets:
                    flat, heads = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
                    minima = np.stack([np.minimum.reduceat(mixed(flat * f), heads) for f in factors], axis=1).reshape(len(sets), bands, ROWS)
                    band = mixed((minima * np.arange(1, ROWS + 1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                else:
                    band = np.zeros((0, bands), np.uint64)
                m, who, begin, length, key = len(sets), *pieces_of(part.column("text"))
                k = len(key)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[ids[owner], ids[who]]), pa.array(np.r_[hashes[owner], hashes[who]]), pa.array(np.repeat(np.array([LINE, PIECE], np.int32), [m, k])),
                    pa.array(np.r_[first, begin].astype(np.int32)), pa.array(np.r_[first + sizes, begin + length].astype(np.int32)),
                    pa.array(np.r_[np.array([node_of(s) for s in sets], np.int64), key.view(np.int64)]),
                    pa.array([*[len(s) for s in sets], *[None] * k], pa.int64()), pa.array([*[bitmap(s).tobytes() for s in sets], *[None] * k], pa.binary()),
                    pa.array([*band.view(np.int64).tolist(), *[None] * k], pa.list_(pa.int64()))],
                    ["id", "hash", "kind", "first", "last", "key", "n", "bits", "bands"])

    return texts.mapInArrow(cut, UNIT_SCHEMA)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, first_word, last_word, cluster_id, keep_id, removed, text_hash``
    of every place of a paragraph that two documents share. The hash tells
    different texts of one id apart, which are judged each by itself."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")).where("id is not null")
    found = stored(units(texts), "units")
    lines, cut = found.where(F.col("kind") == LINE), found.where(F.col("kind") == PIECE)
    nodes = stored(
        lines.withColumnRenamed("key", "node").groupBy("node").agg(
            F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("rows"), F.any_value("n").alias("n"),
            F.any_value("bits").alias("bits"), F.any_value("bands").alias("prefix"), F.size(F.any_value("bands")).alias("short")), "line-nodes")
    named = nodes.join(cluster(nodes, texts, line_sets, PERCENT), "node", "left").withColumn("cluster_id", F.coalesce("component", "node"))
    shared = named.groupBy("cluster_id").agg(F.min("min_id").alias("keep_id"), F.max("max_id").alias("max_id")).where("keep_id < max_id")
    line_keys = named.select(F.col("node").alias("key"), "rows", "cluster_id").join(shared.drop("max_id"), "cluster_id")
    piece_keys = cut.groupBy("key").agg(F.min("id").alias("keep_id"), F.max("id").alias("max_id"), F.count("*").alias("rows")).where("keep_id < max_id")
    keys = stored(line_keys.select("key", F.lit(LINE).alias("kind"), "rows", "cluster_id", "keep_id").unionByName(
        piece_keys.select("key", F.lit(PIECE).alias("kind"), "rows", F.col("key").alias("cluster_id"), "keep_id")), "repeated")
    places = bloom.split(found.select("id", "hash", "kind", "first", "last", "key"), F.col("key"), keys, "key", keys.count(), "maybe").where("maybe").drop("maybe")
    both = hot_join(places, keys.withColumnRenamed("kind", "key_kind"), "key", "rows", found.count()).where("kind = key_kind").drop("key_kind", "rows").distinct()

    # pieces count in runs of enough words; a document's places are bounded by its words
    order = Window.partitionBy("id", "hash", "kind").orderBy("first", "last")
    joins = F.coalesce((F.col("first") == F.lag("last").over(order)), F.lit(False)) & (F.col("kind") == PIECE)
    runs = both.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.col("last") - F.col("first")).over(Window.partitionBy("id", "hash", "kind", "run"))
    kept = runs.withColumn("length", length).where((F.col("kind") == LINE) | (F.col("length") >= RUN_WORDS)).drop("length", "run")
    # of the places in the keeping document, the first one stays
    first = F.row_number().over(Window.partitionBy("id", "hash", "cluster_id").orderBy("first", "last"))
    return kept.withColumn("removed", (F.col("id") != F.col("keep_id")) | (first > 1)).select(
        F.col("id").alias(id_col), F.when(F.col("kind") == LINE, "line").otherwise("passage").alias("kind"),
        F.col("first").alias("first_word"), F.col("last").alias("last_word"), "cluster_id", "keep_id", "removed", F.col("hash").alias("text_hash"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after them."""
    gone = np.zeros(max((b for _, b in spans), default=0), bool)
    for a, b in spans:
        gone[a:b] = True
    out, kept_to = [], 0
    for k, word in enumerate(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text.replace(BREAK, " "))):
        if k >= len(gone):
            break
        if gone[k]:
            out.append(text[kept_to : word.start()])
            kept_to = word.end()
    return "".join([*out, text[kept_to:]])


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the removable places cut out of its texts; rows without any
    are passed on as they are."""
    spans = repeats(df, id_col, text_col).where("removed").groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.collect_list(F.struct("first_word", "last_word")).alias("__spans"))  # bounded by the words of one document
    names, schema = list(df.columns), df.schema
    joined = df.join(spans, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if s is None or t is None else cut_words(t, [(x["first_word"], x["last_word"]) for x in s])
                     for t, s in zip(batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    return joined.select(*names, "__spans").mapInArrow(cut, schema)
