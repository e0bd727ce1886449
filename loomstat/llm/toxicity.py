"""Toxicity by subword-bag embeddings (operator 8).

A word is the mean of the embeddings of its character 3- to 5-grams and of
itself, hashed into a fixed number of buckets; a text is the mean of its words;
a linear softmax reads the class from it. Embeddings and softmax are trained
jointly in numpy by Adagrad. A misspelling that was never seen still shares most
of its grams with the word it comes from.

Training takes a bounded sample of labelled rows outside the held-out fold: the
``SAMPLE_TOXIC`` toxic and ``SAMPLE_OTHER`` other rows of smallest id hash;
each class is weighted back to its number of labelled rows. Scoring is linear in the words, so each distinct word is
worked out once and a text's score is a mean over its words.

Defined results: a null or empty text, or one without word characters, gets the
score of the softmax's bias; without labelled rows of both classes every score
is the labelled share of toxic rows (next to 0 without any). Rows are judged one by
one; other columns are ignored; an empty table gives no rows.
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

from loomstat.llm.common import by_step, fold_of, held_out, per_text, words_of
from loomstat.llm.grams import Spelled, edged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_TOXIC, SAMPLE_OTHER = 1500, 3000
BUCKETS, DIMS, EPOCHS, RATE, BATCH, UPDATES = 1 << 18, 8, 8, 1.0, 32, 800
GRAMS = (3, 4, 5, 6)
#: Buckets met in fewer sampled texts keep a zero embedding: they tell nothing about other texts.
LEAST_TEXTS = 3
#: A text's mean is multiplied by this before the softmax: one word in a few hundred must be able to decide.
GAIN = 30.0
DECAY, START = 1e-6, 0.05
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Model:
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word (by place) and bucket of every gram and of every word itself, for
    distinct words, all at once; nothing for those without word characters."""
    bare = pc.utf8_trim(pc.utf8_lower(words.cast(pa.large_string())), EDGES)
    real = np.flatnonzero(pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)
    padded = edged(bare.take(pa.array(real)), "<", ">")
    spelled = Spelled(padded)
    found = [*map(spelled.grams, GRAMS), (np.arange(len(real)), spelled.whole())]
    of, hashes = (np.concatenate(x) for x in zip(*found))
    return real[of], (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, buckets and weights: each text as the mean of its words, each word as the mean of its subwords."""
    starts, cols, weights = [0], [], []
    for k in range(0, len(texts), 64):
        counts, index, words = words_of(texts.take(pa.array(np.arange(k, min(k + 64, len(texts))))))
        of, bucket = subwords(words)
        order = np.argsort(of, kind="stable")
        sizes, flat = np.bincount(of, minlength=len(words)), bucket[order]
        at = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(counts)), counts)
        real = sizes[index] > 0
        pair, n = np.unique(owner[real] * max(1, len(words)) + index[real], return_counts=True)
        row, word = pair // max(1, len(words)), pair % max(1, len(words))
        each = sizes[word]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        share = np.repeat(n / np.bincount(row, weights=n, minlength=len(counts))[row] / np.maximum(1, each), each)
        key, back = np.unique(np.repeat(row, each) * BUCKETS + flat[np.repeat(at[word], each) + inner], return_inverse=True)
        weights.append(np.bincount(back, weights=share, minlength=len(key)).astype(np.float32))
        cols.append((key % BUCKETS).astype(np.int32))
        starts += (starts[-1] + np.searchsorted(key // BUCKETS, np.arange(len(counts)), side="right")).tolist()
    return np.array(starts), np.concatenate([np.zeros(0, np.int32), *cols]), np.concatenate([np.zeros(0, np.float32), *weights])


def run_sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``heads``; column by column, which numpy does much faster."""
    return np.stack([np.add.reduceat(np.ascontiguousarray(column), heads) for column in values.T], axis=1)


def fit(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Model:
    """Train on texts with labels 0 and 1: embeddings and softmax together, by Adagrad over small batches."""
    rng = np.random.default_rng(seed)
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    bias = np.log(np.array([max(1e-12, 1 - share), max(1e-12, share)]))
    embeddings, softmax = np.zeros((BUCKETS, DIMS), np.float32), np.zeros((DIMS, 2), np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(embeddings, softmax, bias)
    starts, cols, values = _bags(texts)
    kept = np.bincount(cols, minlength=BUCKETS) >= LEAST_TEXTS
    embeddings[kept] = rng.normal(0, START, (int(kept.sum()), DIMS))
    softmax[:] = rng.normal(0, 1 / np.sqrt(DIMS), softmax.shape)
    held = kept[cols]
    starts = np.r_[0, np.cumsum(held)][starts]
    cols, values = cols[held], values[held] * np.float32(GAIN)
    truth, importance = np.eye(2, dtype=np.float32)[labels], (weights / weights.mean()).astype(np.float32)
    seen_e, seen_s, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(softmax, 1e-8), np.full_like(bias, 1e-8)
    epochs = int(np.clip(UPDATES * BATCH // len(labels), EPOCHS, 8 * EPOCHS))  # few rows are seen more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            sizes = starts[rows + 1] - starts[rows]
            rows = rows[sizes > 0]
            if not len(rows):
                continue
            sizes = sizes[sizes > 0]
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - sizes), sizes)
            c, v = cols[place], values[place]
            mean = run_sums(embeddings[c] * v[:, None], ends - sizes)
            z = mean @ softmax + bias
            q = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (q / q.sum(axis=1, keepdims=True) - truth[rows]) * (importance[rows] / len(rows))[:, None]
            by_text = dz @ softmax.T
            first = np.argsort(c, kind="stable")  # entries of one bucket end to end
            ordered = c[first]
            heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            which = ordered[heads]
            grad = run_sums((by_text[np.repeat(np.arange(len(rows)), sizes)] * v[:, None])[first], heads) + DECAY * embeddings[which]
            seen_e[which] += (grad * grad).mean(axis=1)
            embeddings[which] -= rate * grad / np.sqrt(seen_e[which])[:, None]
            for p, s, g in ((softmax, seen_s, mean.T @ dz), (bias, seen_b, dz.sum(axis=0))):
                s += g * g
                p -= 0.1 * rate * g / np.sqrt(s)
    return Model(embeddings, softmax, bias)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The bounded training sample: texts, labels, weights."""
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (fold_of(F.col("id")) != 0))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    size = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = [marks.where(F.col("label") == y).orderBy(*order).limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER))]
    picked = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = (  # one text of each id; the picked ids are bounded, so they are sent to the texts
        rows.join(F.broadcast(picked), F.col("doc") == F.col("id")).groupBy("id", "label").agg(F.min("text").alias("text"))
        .orderBy("id").select("text", "label").toArrow()
    )
    y = got.column("label").to_numpy().astype(np.int64)
    taken = np.bincount(y, minlength=2)
    weight = np.array([size.get(k, 0) / max(1, taken[k]) for k in (0, 1)])
    texts = got.column("text").combine_chunks()
    return texts, y, weight[y]


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` instead of its text."""
    line = (model.embeddings @ (model.softmax[:, 1] - model.softmax[:, 0]) * GAIN).astype(np.float64)
    shared = df.sparkSession.sparkContext.broadcast(line)
    bias = float(model.bias[1] - model.bias[0])
    others = [c for c in df.columns if c != text_col]

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, index, words = words_of(part.column(text_col))
            of, bucket = subwords(words)
            grams = np.bincount(of, minlength=len(words))
            mean = np.bincount(of, weights=weights[bucket], minlength=len(words)) / np.maximum(1, grams)
            sums = per_text(counts, np.stack([mean, grams > 0], axis=1)[index])
            z = np.clip(sums[:, 0] / np.maximum(1, sums[:, 1]) + bias, -700, 700)
            return pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(1 / (1 + np.exp(-z)), pa.float64())], [*others, "score"])

        yield from by_step(one, text_col)(batches)

    return df.mapInArrow(scorer, df.select(*others).schema.add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = fit(*sampled(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
