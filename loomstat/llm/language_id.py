"""Language identification by word-first backoff (operator 10).

A word known from training scores by its log frequency in each language. An
unknown word falls back to its character 5-grams, then 4-grams and so on, and
scores by the first length of which at least one gram is known. The scores of a
text's words add up; the result is the language with the largest sum and its
posterior probability.

Training counts all words and grams of a bounded sample, the ``SAMPLE``
labelled rows of smallest id hash. Words and grams are known by 64-bit hashes,
so that counting and scoring work on all distinct words of a part at once.

Defined results: ``und`` with score 0 for a null text, for a text without a
letter, and when nothing could be learned; a text whose letters are all
unknown gets the most frequent language and its share. Ties go to the language
first by name. Other columns are ignored by ``predict`` and kept by
``accepted``, which drops only texts without a letter when nothing could be
learned; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import by_step, fold_of, held_out, per_text, stored, words_of
from loomstat.llm.grams import Spelled, edged, hash_table, look_up

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 8_000
LONGEST_GRAM = 5
UNKNOWN = "und"
COUNT_SCHEMA = "lang string, item long, n long"


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    grams: tuple[np.ndarray, np.ndarray]
    word_scores: np.ndarray
    gram_scores: np.ndarray


def letters(words: pa.Array) -> pa.Array:
    """The letters of each word, in lower case."""
    return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), r"[^\pL]+", "")


def grams_of(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and hash of every gram of ``n`` characters; longer than one, they may hold a word's edge."""
    return Spelled(edged(words, " ", " ") if n > 1 else words).grams(n)


def _summed(lang: np.ndarray, item: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Counts by language and item."""
    order = np.lexsort((item, lang))
    lang, item, n = lang[order], item[order], n[order]
    first = np.flatnonzero(np.r_[len(item) > 0, (item[1:] != item[:-1]) | (lang[1:] != lang[:-1])])
    total = np.add.reduceat(n, first) if len(first) else n
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(lang[first])), pa.array(item[first].view(np.int64)), pa.array(total)], ["lang", "item", "n"])


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """Words by language."""
    counts, index, words = words_of(part.column("text"))
    langs = part.column("lang").dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
    pair, n = np.unique(lang * max(1, len(words)) + index, return_counts=True)
    lang, word = pair // max(1, len(words)), pair % max(1, len(words))
    named = letters(words)
    real = (pc.binary_length(named).to_numpy(zero_copy_only=False) > 0)[word]
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(lang[real])), named.cast(pa.string()).take(pa.array(word[real])), pa.array(n[real])], ["lang", "word", "n"])


def _word_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        item = Spelled(b.column("word").cast(pa.large_string())).whole()
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(item.view(np.int64)), b.column("n")], ["lang", "item", "n"])


def _gram_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of counted words, counted by language."""
    for b in batches:
        langs, n, words = b.column("lang").dictionary_encode(), b.column("n").to_numpy(), b.column("word").cast(pa.large_string())
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for size in range(1, LONGEST_GRAM + 1):
            word, item = grams_of(words, size)
            yield _summed(lang[word], item, n[word], langs.dictionary)


def _scores(counts: DataFrame, langs: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Items with their log frequencies by language, less the mean over languages."""
    got = counts.toArrow()
    items, row = np.unique(got.column("item").to_numpy().view(np.uint64), return_inverse=True)
    n = np.zeros((len(items), len(langs)), np.float32)
    n[row, pc.index_in(got.column("lang"), pa.array(langs, pa.string())).to_numpy()] = got.column("n").to_numpy()
    p = np.log((n + 0.5) / (n.sum(axis=0, dtype=np.float64) + 0.5 * max(1, len(items))))
    return hash_table(items), (p - p.mean(axis=1, keepdims=True)).astype(np.float32) if langs else n


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold_of(F.col("id")) != 0)).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last)).select("text", "lang") if last is not None else rows.limit(0).select("text", "lang")
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(shares)
    counted = rows.mapInArrow(by_step(_count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "word-counts")
    known, word_scores = _scores(counted.mapInArrow(_word_items, COUNT_SCHEMA), langs)
    spelled = counted.mapInArrow(_gram_items, COUNT_SCHEMA).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    parts, gram_scores = _scores(spelled, langs)
    share = np.array([shares[x] for x in langs], float)
    return Model(langs, np.log(share / share.sum()) if langs else share, known, parts, word_scores, gram_scores)


def word_scores(model: Model, words: pa.Array) -> np.ndarray:
    """Scores by language of words of letters, and whether there is a letter at all."""
    out = np.zeros((len(words), len(model.langs) + 1), np.float32)
    real = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)
    out[real, -1] = 1
    at = look_up(model.words, Spelled(words.take(pa.array(real))).whole())
    out[real[at >= 0], :-1] = model.word_scores[at[at >= 0]]
    left = real[at < 0]
    for n in range(LONGEST_GRAM, 0, -1):
        if not len(left):
            break
        word, item = grams_of(words.take(pa.array(left)), n)
        at = look_up(model.grams, item)
        word, at = word[at >= 0], at[at >= 0]
        found = np.bincount(word, minlength=len(left))
        for k in range(len(model.langs)):
            total = np.bincount(word, weights=model.gram_scores[at, k], minlength=len(left))
            out[left, k] = total / np.maximum(1, found)  # 0 where a shorter gram decides
        left = left[found == 0]
    return out


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language of each text, its posterior, and whether the text has a letter."""
    counts, index, words = words_of(texts)
    total = per_text(counts, word_scores(model, letters(words))[index])
    spoken = total[:, -1] > 0
    if not model.langs:
        return np.full(len(counts), -1), np.zeros(len(counts)), spoken
    z = total[:, :-1] + model.prior
    score = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(spoken, z.argmax(axis=1), -1), np.where(spoken, score, 0.0), spoken


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` instead of its text."""
    shared = df.sparkSession.sparkContext.broadcast(vars(model))
    others = [c for c in df.columns if c != text_col]
    schema = df.select(*others).schema.add("lang_pred", "string").add("score", "double")

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(**shared.value)
        names = pa.array([*held.langs, UNKNOWN], pa.string())

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            best, score, _ = score_texts(held, part.column(text_col))
            return pa.RecordBatch.from_arrays([*[part.column(c) for c in others], names.take(pa.array(best % len(names))), pa.array(score, pa.float64())],
                                              [*others, "lang_pred", "score"])

        yield from by_step(one, text_col)(batches)

    return df.mapInArrow(scorer, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = train(df, id_col, text_col, lang_col)
    rows = df.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model)


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """Rows of ``df`` whose language is recognised with a posterior of ``least``.
    The text is judged where the row is: nothing is joined or shuffled."""
    model = train(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(vars(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(**shared.value)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            _, score, spoken = score_texts(held, part.column(text_col))
            return part.filter(pa.array(spoken & (score >= least) if held.langs else spoken))

        yield from by_step(one, text_col)(batches)

    return df.mapInArrow(keep, df.schema)
