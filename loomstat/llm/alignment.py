"""Cross-tokenizer alignment by galloping intersection of token ends (operator 12).

Two tokenizers cut the same bytes differently. The offsets where tokens of both
end cut a text into groups. They are found by galloping: the text's shorter
list of ends drives, and each of its ends is sought in the longer list from the
place its rank suggests, in steps that double until the end is passed, then by
halving. The common indices slice both lists into groups, and differences of
ranks give how many tokens each group holds of either side. All texts of a part
are searched together in numpy.

Pairs of ids that end together are counted over the whole corpus. The counts
are joined back in two ways: pairs that make more than one in 2^20 of all links
are at most 2^20, so they are sent to the tasks; the others are rare, so their
rows are few and no key is hot, and they are shuffled.

Defined results: null and empty texts, and texts whose bytes a tokenizer does
not give back, have no tokens: zeros and an empty digest. Repeated ids and rows
are judged each by itself; an empty table gives no rows; other columns are
ignored, whatever their names. Texts are read in bounded parts; a text longer
than a part makes a part of its own.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import steps, stored
from loomstat.llm.encoding import spread, tokenizer_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: Pairs that make more than one in this number of all links are sent to the tasks: there are at most so many.
FREQUENT = 1 << 20
STEP = 1_000_000
ROW_SCHEMA = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, times array<long>")


def byte_values() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as a mapping back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Pair:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        values = byte_values()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        self.bytes_a = [bytes(values[c] for c in e) if all(c in values for c in e) else e.encode() for e in entries]
        # this vocabulary's ids are its merge ranks: the same ids, four times as fast
        ranks = {x: k for k, x in enumerate(self.bytes_a) if entries[k] not in self.special()}
        self.ranked = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if a == BYTE_TOKENIZER else None
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.text_a, self.last_a, self.text_b, self.last_b = (
            np.array([str(k) + end for k in range(n)], object) for n, end in ((size, ","), (size, "|"), (len(pieces), ","), (len(pieces), ";")))

    def special(self) -> set[str]:
        return {t.content for t in self.a.get_added_tokens_decoder().values()}

    def first_ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each text by either tokenizer; none where a tokenizer loses bytes."""
        whole = [" " + t for t in texts]
        a = self.first_ids(whole)
        b = self.b.encode(texts, num_threads=1)
        for k, text in enumerate(whole):
            data = text.encode()
            if data != b"".join(map(self.bytes_a.__getitem__, a[k])) or data != b"".join(map(self.bytes_b.__getitem__, b[k])):
                a[k], b[k] = [], []
        return a, b


def process_pair(a: str, b: str) -> Pair:
    """The tokenizers of this worker process."""
    memo = sys.modules.setdefault("_pairs_of_process", types.ModuleType("_pairs_of_process")).__dict__
    if (a, b) not in memo:
        memo[a, b] = Pair(a, b)
    return memo[a, b]


def gallop(wanted: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """First place in ``ends[low:high]`` (ascending) not below each wanted value, sought from ``guess``.

    Every value doubles its step away from its guess until it is bracketed,
    then halves the bracket.
    """
    if not len(wanted):
        return np.zeros(0, np.int64)
    padded = np.r_[ends, 0]
    at = np.clip(guess, low, np.maximum(high - 1, low))
    below = padded[at] < wanted
    lo, hi = np.where(below, at + 1, low), np.where(below, high, at)
    step, live = 1, np.arange(len(wanted))
    while len(live):
        up = below[live]
        probe = np.where(up, at[live] + step, at[live] - step)
        inside = (probe >= lo[live]) & (probe < hi[live])
        live, probe, up = live[inside], probe[inside], up[inside]
        less = padded[probe] < wanted[live]
        lo[live[less]] = probe[less] + 1
        hi[live[~less]] = probe[~less]
        live = live[less == up]  # the rest have passed their value
        step *= 2
    live = np.flatnonzero(lo < hi)
    while len(live):
        middle = (lo[live] + hi[live]) // 2
        less = padded[middle] < wanted[live]
        lo[live[less]] = middle[less] + 1
        hi[live[~less]] = middle[~less]
        live = live[lo[live] < hi[live]]
    return lo


def driven(short: np.ndarray, s_first: np.ndarray, s_n: np.ndarray, long: np.ndarray, l_first: np.ndarray, l_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common values of lists: places in ``short`` and in ``long``. List k is ``[first[k], first[k] + n[k])`` of each."""
    mine = spread(s_first, s_n)
    rank = mine - np.repeat(s_first, s_n)
    low, size = np.repeat(l_first, s_n), np.repeat(l_n, s_n)
    place = gallop(short[mine], long, low, low + size, low + rank * size // np.maximum(np.repeat(s_n, s_n), 1))
    hit = (place < low + size) & (np.r_[long, 0][place] == short[mine])
    return mine[hit], place[hit]


def lasts(ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the last token at each end (a token without bytes ends where the one before it did)."""
    return np.flatnonzero(np.r_[(ends[1:] != ends[:-1]) | (owner[1:] != owner[:-1]), True]) if len(ends) else np.zeros(0, np.int64)


def aligned(sizes: tuple[np.ndarray, np.ndarray], a: list[list[int]], b: list[list[int]]) -> dict:
    """Groups and links of many texts at once, as numpy arrays.

    ``group_a``/``group_b``: one place past each group's last token, ``group_of``: its text,
    ``link_a``/``link_b``: token places of each link, ``link_of``: its text.
    """
    flat, n, first, ends, owner, last = [], [], [], [], [], []
    for size, lists in zip(sizes, (a, b)):
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((x for ids in lists for x in ids), np.int64, int(counts.sum()))
        begin = np.cumsum(counts) - counts
        total = np.cumsum(size[ids])
        before = np.r_[0, total][begin]
        of = np.repeat(np.arange(len(lists)), counts)
        flat.append(ids), n.append(counts), first.append(begin), ends.append(total - before[of]), owner.append(of)
        last.append(lasts(ends[-1], of))
    # distinct ends, and how many tokens share each
    each = [ends[s][last[s]] for s in (0, 1)]
    share = [np.diff(np.r_[-1, last[s]]) for s in (0, 1)]
    m = [np.bincount(owner[s][last[s]], minlength=len(a)) for s in (0, 1)]
    at = [np.cumsum(x) - x for x in m]
    less = m[0] <= m[1]
    i1, j1 = driven(each[0], at[0][less], m[0][less], each[1], at[1][less], m[1][less])
    j2, i2 = driven(each[1], at[1][~less], m[1][~less], each[0], at[0][~less], m[0][~less])
    i, j = np.r_[i1, i2], np.r_[j1, j2]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    na, nb = share[0][i], share[1][j]
    links = na * nb
    within = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    wide = np.repeat(nb, links)
    return {
        "ids": flat, "n": n, "first": first, "group_a": last[0][i] + 1, "group_b": last[1][j] + 1, "group_of": owner[0][last[0][i]],
        "link_a": np.repeat(last[0][i] + 1 - na, links) + within // np.maximum(wide, 1),
        "link_b": np.repeat(last[1][j] + 1 - nb, links) + within % np.maximum(wide, 1),
        "link_of": np.repeat(owner[0][last[0][i]], links)}


def group_texts(pair: Pair, x: dict) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text: pieces with their separators, put in order by ranks."""
    (ids_a, ids_b), (n_a, n_b) = x["ids"], x["n"]
    ga, gb = x["group_a"], x["group_b"]
    words_a, words_b = pair.text_a[ids_a], pair.text_b[ids_b]
    words_a[ga - 1], words_b[gb - 1] = pair.last_a[ids_a[ga - 1]], pair.last_b[ids_b[gb - 1]]
    size_a, size_b = np.diff(np.r_[0, ga]), np.diff(np.r_[0, gb])  # every text with tokens ends with a group
    pieces = np.empty(len(ids_a) + len(ids_b), object)
    pieces[np.arange(len(ids_a)) + np.repeat(gb - size_b, size_a)] = words_a
    pieces[np.arange(len(ids_b)) + np.repeat(ga, size_b)] = words_b
    pieces, stops = pieces.tolist(), np.cumsum(n_a + n_b).tolist()
    return ["".join(pieces[p:q])[:-1] for p, q in zip([0, *stops], stops)]


def rows_of(names: tuple[str, str]):
    """``mapInArrow`` function: the alignment of each text, and its id pairs with their number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = process_pair(*names)
        n_b = len(pair.bytes_b)
        for batch in batches:
            for part in steps(batch, "text", STEP):
                texts = [t or "" for t in part.column("text").to_pylist()]
                full = [k for k, t in enumerate(texts) if t]
                a, b = [[] for _ in texts], [[] for _ in texts]
                for k, x, y in zip(full, *pair.ids([texts[k] for k in full])):
                    a[k], b[k] = x, y
                x = aligned(pair.sizes, a, b)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(pair, x)]
                of, codes = x["link_of"], x["ids"][0][x["link_a"]] * n_b + x["ids"][1][x["link_b"]]
                both, times = np.unique(of << 40 | codes, return_counts=True)
                places = np.searchsorted(both >> 40, np.arange(len(texts) + 1)).astype(np.int32)
                count = lambda y: pa.array(np.bincount(y, minlength=len(texts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), pa.array(x["n"][0]), pa.array(x["n"][1]), count(x["group_of"]), count(of),
                    pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(places), pa.array(both & ((1 << 40) - 1))),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(times.astype(np.int64)))],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by id pair, summed where the rows are."""
    for batch in batches:
        codes, at = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, at, batch.column("times").flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total)], ["pair", "n"])


def looked_up(known):
    """``mapInArrow`` function: sums over the links of frequent pairs, a row per text, and a row per other pair of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            at = np.searchsorted(codes, pairs)
            hit = np.r_[codes, -1][at] == pairs
            sums, tops = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, of[hit], times[hit] * counts[at[hit]])
            np.add.at(tops, of[hit], times[hit] * best[at[hit]])
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            n, rest = batch.num_rows, int((~hit).sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[rows, rows[of[~hit]]]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[~hit])]),
                pa.array(np.r_[sums, np.zeros(rest, np.int64)]), pa.array(np.r_[tops, times[~hit]])], ["row", "pair", "count_sum", "n_best"])

    return run


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = (BYTE_TOKENIZER, PIECE_TOKENIZER),
          frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts the links whose id pair is the most frequent of its
    second id, ``count_sum`` adds up the corpus-wide counts of all links.
    """
    spark = df.sparkSession
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(texts.mapInArrow(rows_of(names), ROW_SCHEMA), "aligned")
    n_b = len(process_pair(*names).bytes_b)
    counts = stored(rows.select("pairs", "times").mapInArrow(pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair") % n_b
    top = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))
    judged = stored(counts.join(top, second == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-judged")
    limit = (judged.agg(F.sum("n")).first()[0] or 0) // frequent
    held = judged.where(F.col("n") > limit).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "n", "best")))
    try:
        parts = stored(rows.select("row", "pairs", "times").mapInArrow(looked_up(known), "row long, pair long, count_sum long, n_best long"), "link-sums")
    finally:
        known.destroy()
    rare = (
        parts.where("pair is not null").join(judged.where(F.col("n") <= limit).withColumnRenamed("pair", "code"), F.col("pair") == F.col("code"))
        .select("row", (F.col("n_best") * F.col("n")).alias("count_sum"), (F.col("n_best") * F.col("best")).alias("n_best"))
    )
    sums = parts.where("pair is null").drop("pair").unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.drop("pairs", "times").join(sums, "row").select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
