"""Source divergence audit with a frequent-pattern tree of term rows (operator 13).

Every language keeps the terms found in enough of its documents. A source's
share of a term is ``1 + floor(10^9 (count + 5) / (N + 5 V))``; sources are
compared by the sum of absolute differences over all kept terms, and a source's
own terms are those whose share exceeds the language's.

Most terms miss most sources, so the comparison starts from the case "in
neither source" for every pair, adds what one source's nonzero counts change
alone, and then corrects the terms both sources hold. A term's row is the path
of its nonzero sources in their order; equal paths are counted first and then
inserted into a prefix tree with that multiplicity. Each combination of a node
and an ancestor corrects one pair of sources once for all terms below the node.
Corrections are sums, so every task builds the trees of its own range of sorted
paths, and a lost task is simply run again.

Arithmetic is exact in 64 bits: shares by long division in steps of 1,000,
right for totals below 9 * 10^15.

Defined results: null text, lang and source count as ''; a text without a term
still makes its source occur; without kept terms all pair values are 0 and no
term is listed; repeated rows count as documents each; an empty table gives no
rows; other columns are ignored, whatever their names. A row of the audit holds
a language's list of sources, so that list must fit a task; texts are read in
bounded parts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import by_step, hot_join, parallelism, stored, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_DOCS = 30
TOP_TERMS = 50
COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"
PAIR_SCHEMA = "lang string, source string, item string, value long"

#: Bytes outside terms become spaces, A-Z becomes a-z, and all bytes of other letters and signs stay.
BYTES = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def terms_only(texts: pa.Array) -> pa.Array:
    """The terms of each text in lower case, separated by spaces, byte for byte in place."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    if data is None or whole.offset:
        whole = pa.array(whole.to_pylist(), pa.large_string())
        _, offsets, data = whole.buffers()
    data = pa.py_buffer(BYTES[np.frombuffer(data, np.uint8)] if data is not None and data.size else b"")
    return pa.LargeStringArray.from_buffers(len(whole), offsets, data)


def counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents by (lang, source, term), and a row without a term for each (lang, source)."""
    codes, names = [], []
    for column in ("lang", "source"):
        coded = pc.fill_null(part.column(column).cast(pa.string()), "").dictionary_encode()
        codes.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        names.append(coded.dictionary)
    pairs, group = np.unique(codes[0] * len(names[1]) + codes[1], return_inverse=True)
    counts, index, words = words_of(terms_only(part.column("text")))
    size = max(len(words), 1)
    keys, n = np.unique(np.repeat(group, counts) * size + index, return_counts=True)
    once = np.unique(np.repeat(np.arange(len(counts)), counts) * size + index)
    docs = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
    of = pairs[np.r_[keys // size, np.arange(len(pairs))]]
    lang, source = (names[k].take(pa.array(c)) for k, c in enumerate((of // len(names[1]), of % len(names[1]))))
    term = pa.concat_arrays([words.cast(pa.string()).take(pa.array(keys % size)), pa.nulls(len(pairs), pa.string())])
    none = np.zeros(len(pairs), np.int64)
    return pa.RecordBatch.from_arrays(
        [lang, source, term, pa.array(np.r_[n, none]), pa.array(np.r_[docs, np.bincount(group, minlength=len(pairs))])],
        ["lang", "source", "term", "n", "docs"])


def share(count: str, total: str, terms: str) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 terms))``; the names are columns."""
    below = f"({total} + 5 * {terms})"
    whole, left = f"(({count} + 5) div {below})", f"(({count} + 5) % {below})"
    for _ in range(3):
        whole, left = f"({whole} * 1000 + ({left} * 1000) div {below})", f"(({left} * 1000) % {below})"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {whole} END")


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the exact sums of their values."""
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, values)
    return distinct, total


def corrections(lengths: np.ndarray, item: np.ndarray, p: np.ndarray, z: np.ndarray, times: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Insert sorted paths into a prefix tree and correct each pair of sources.

    Path k has ``lengths[k]`` items end to end in ``item`` (a source as a
    number below ``n_items``), ``p`` and ``z`` (its share here and at count
    0), and stands for ``times[k]`` terms. Returns pair keys ``ancestor *
    n_items + item`` and sums.
    """
    first = np.cumsum(lengths) - lengths
    levels: list[tuple[np.ndarray, ...]] = []  # of the nodes of a depth: item, p, z, parent, terms
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, up = np.flatnonzero(lengths > 0), np.zeros(int((lengths > 0).sum()), np.int64)
    while len(rows):
        at = first[rows] + len(levels)
        fresh = np.r_[True, (up[1:] != up[:-1]) | (item[at[1:]] != item[at[:-1]]) | (p[at[1:]] != p[at[:-1]])]
        node = np.cumsum(fresh) - 1
        heads = at[fresh]
        terms = np.zeros(len(heads), np.int64)
        np.add.at(terms, node, times[rows])
        levels.append((item[heads], p[heads], z[heads], up[fresh], terms))
        anc = up[fresh]
        for above in range(len(levels) - 2, -1, -1):
            i2, p2, z2, higher, _ = levels[above]
            pa_, za = p2[anc], z2[anc]
            change = np.abs(p[heads] - pa_) - np.abs(p[heads] - za) - np.abs(z[heads] - pa_) + np.abs(z[heads] - za)
            more = summed(i2[anc] * n_items + item[heads], change * terms)
            keys, sums = summed(np.r_[keys, more[0]], np.r_[sums, more[1]])
            anc = higher[anc]
        on = lengths[rows] > len(levels)
        rows, up = rows[on], node[on]
    return keys, sums


def pair_batch(lang: pa.Array, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, source, item, pa.array(value)], ["lang", "source", "item", "value"])


def both_present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of the pairs of sources from ``lang, path, times`` in order, both ways round."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, lists = batch.column("lang").dictionary_encode(), batch.column("path")
        of_lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        items = lists.flatten()
        sources = pc.struct_field(items, "source").dictionary_encode()
        p, z = (pc.struct_field(items, c).to_numpy(zero_copy_only=False) for c in ("p", "z"))
        # a source of two languages is two items, so no node is shared between languages
        n_sources = max(len(sources.dictionary), 1)
        item = np.repeat(of_lang, lengths) * n_sources + sources.indices.to_numpy(zero_copy_only=False)
        n_items = n_sources * len(langs.dictionary)
        keys, sums = corrections(lengths, item, p, z, batch.column("times").to_numpy(zero_copy_only=False), n_items)
        a, b = keys // n_items, keys % n_items
        lang = langs.dictionary.take(pa.array(a // n_sources))
        one, two = (sources.dictionary.take(pa.array(x % n_sources)) for x in (a, b))
        yield pair_batch(lang, one, two, sums)
        yield pair_batch(lang, two, one, sums)


def one_present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What holds for a pair before corrections: all terms in neither source,
    then the terms of one source against a count of 0 in the other.

    A row is a source: its shares and their multiplicities, its share ``z`` at
    count 0, the number of kept terms, and the sources of its language.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            lang, source, z, terms = (batch.column(c)[k].as_py() for c in ("lang", "source", "z", "terms"))
            others, held = batch.column("others")[k].values, batch.column("held")[k].values
            names, zero = pc.struct_field(others, "source"), pc.struct_field(others, "z").to_numpy(zero_copy_only=False)
            there = pc.not_equal(names, source)
            names, zero = names.filter(there), zero[there.to_numpy(zero_copy_only=False)]
            p, m = (pc.struct_field(held, c).to_numpy(zero_copy_only=False) for c in ("p", "m"))
            order = np.argsort(p)
            p, m = p[order], m[order]
            weight, total = np.r_[0, np.cumsum(m)], np.r_[0, np.cumsum(m * p)]
            low = np.searchsorted(p, zero)  # shares below the other's are its larger part
            apart = zero * weight[low] - total[low] + total[-1] - total[low] - zero * (weight[-1] - weight[low])
            alone = apart - np.abs(z - zero) * weight[-1]
            here, there_ = pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string())
            yield pair_batch(here, there_, names, alone + terms * np.abs(z - zero))
            yield pair_batch(here, names, there_, alone)


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by distance
    (part ``pair``, farthest first) and the source's own terms (part ``term``)."""
    texts = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    counts = stored(
        texts.mapInArrow(by_step(counted), COUNT_SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "term-counts")
    kept = stored(
        counts.where("term is not null").groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found"))
        .where(F.col("docs") >= least_docs).select("lang", "term", "total", F.inline("found").alias("source", "n")), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("in_lang"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_source"), F.count("*").alias("size"))
    groups = stored(
        counts.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_source", "size", "terms", "in_lang")])
        .withColumn("zero", F.lit(0).cast("long"))
        .select("lang", "source", "in_source", "size", "terms", "in_lang", F.coalesce(share("zero", "in_source", "terms"), F.lit(0).cast("long")).alias("z")),
        "term-groups")
    named = groups.select(F.struct("lang", "source").alias("of"), "in_source", "size", "terms", "in_lang", "z")
    n = kept.count()
    shares = stored(
        hot_join(kept.withColumn("of", F.struct("lang", "source")), named, "of", "size", n)
        .select("lang", "source", "term", share("n", "in_source", "terms").alias("p"), "z", share("total", "in_lang", "terms").alias("q")),
        "term-shares")

    paths = (
        shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("path"))
        .groupBy("lang", "path").agg(F.count("*").alias("times"))
        .repartitionByRange(parallelism(df.sparkSession), "lang", "path").sortWithinPartitions("lang", "path")
    )
    held = (
        shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
        .groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("held"))
    )
    none = F.expr("CAST(array() AS array<struct<p: bigint, m: bigint>>)")
    sources = (
        groups.join(held, ["lang", "source"], "left")
        .join(groups.groupBy("lang").agg(F.collect_list(F.struct("source", "z")).alias("others")), "lang")
        .select("lang", "source", "z", "terms", "others", F.coalesce("held", none).alias("held"))
    )
    pairs = (
        paths.mapInArrow(both_present, PAIR_SCHEMA).unionByName(sources.mapInArrow(one_present, PAIR_SCHEMA))
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    )
    own = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
