"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, their character n-grams and repeats of the word before, all
hashed into a fixed number of buckets; a softmax layer scores it; numpy trains both by stochastic gradient descent.
The model is fitted on the driver on at most `TRAIN_ROWS` labelled rows of at most `TRAIN_CHARS` characters (documented bounds), chosen
by a hash of the id among rows outside the held-out fold; every document is scored on the executors, on its whole text. With two classes
the fitted vectors and output layer fold into one number a bucket, so a word seen twice in a chunk costs nothing.

Defined cases: a null or empty text has no features and gets the score of the bias alone; each input row gives one
result row, also repeated ones; a null id is in no fold (held_out null) and never trained on; rows whose label is null
or that have two labels count once for each label; without training rows every score is 0.5; of labelled rows with equal hash
the smaller id is taken; a very long text is scored whole, in one piece; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import bounded_batches

BUCKETS, DIM, NGRAMS, EPOCHS, RATE, BATCH, SEED = 1 << 17, 8, (3, 4), 8, 2.0, 32, 7
#: Fewer rows get more epochs, so that a fit never stops after a few steps.
LEAST_STEPS = 800
TRAIN_ROWS, FOLDS, THRESHOLD = 3000, 5, 0.3
#: Labelled texts of more characters are no training rows, so that what reaches the driver is bounded.
TRAIN_CHARS = 200_000


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, W.Words]:
    """(bucket of each feature of each different word, features a word, word number of each word, repeats a text, words) of a chunk."""
    w = W.Words(data, offsets, W.byte_class(False, False))
    h = w.hashes()
    uniq, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    text = w.text_of_word()
    again = np.zeros(len(w.counts), np.int64)
    if len(h) > 1:
        again = np.bincount(text[1:], weights=(h[1:] == h[:-1]) & (text[1:] == text[:-1]), minlength=len(w.counts)).astype(np.int64)
    s, e = w.starts[index], w.ends[index]
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], ord(">"), np.uint8)
    pos = np.arange(at[-1]) - np.repeat(at[:-1], size)
    inner = (pos > 0) & (pos < np.repeat(size - 1, size))
    flat[inner] = data[(np.repeat(s, size) + pos - 1)[inner]]
    flat[at[:-1]] = ord("<")
    lead = np.flatnonzero((flat & 0xC0) != 0x80)  # characters, not bytes
    char_at = np.searchsorted(lead, at)
    up, down = W.BYTE_POWERS(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.BYTE_VALUES[flat] * up[: len(flat)], dtype=np.uint64)])
    lead_end = np.append(lead, len(flat))
    found, owner = [W.mix(uniq + np.uint64(1))], [np.arange(len(uniq))]
    word_of = np.repeat(np.arange(len(uniq)), np.diff(char_at))
    for n in NGRAMS:
        k = np.arange(max(0, len(lead) - n + 1))
        k = k[word_of[k] == word_of[k + n - 1]] if len(k) else k
        a, b = lead_end[k], lead_end[k + n]
        found.append(W.mix((sums[b] - sums[a]) * down[a] + np.uint64(n << 8)))
        owner.append(word_of[k])
    bucket, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, np.bincount(owner, minlength=len(uniq)), inverse, again, w


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights that sum to 1) of each text; bucket 0 is the repeat of a word."""
    out = []
    for _, _, data, offsets in W.chunks(pa.array(texts, pa.string())):
        bucket, per_word, inverse, again, w = features(data, offsets)
        at = np.concatenate([[0], np.cumsum(per_word)])
        for i in range(len(w.counts)):
            ids, n = np.unique(inverse[w.first[i] : w.first[i + 1]], return_counts=True)
            b = bucket[spread(at[ids], per_word[ids])]
            total = np.bincount(np.append(b, 0), weights=np.append(np.repeat(n, per_word[ids]), again[i]))
            ids = np.flatnonzero(total)
            out.append((ids, total[ids] / max(total.sum(), 1)))
    return out


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the difference of the two classes' logits."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    bag = bags(texts)
    an_epoch = -(-len(bag) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // an_epoch))
    steps, done = epochs * an_epoch, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(bag)), an_epoch):
            rows = [r for r in rows if len(bag[r][0])]
            if not rows:
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            size = np.array([len(bag[r][0]) for r in rows])
            ids = np.concatenate([bag[r][0] for r in rows])
            weight = np.concatenate([bag[r][1] for r in rows]).astype(np.float32)
            mean = np.add.reduceat(vectors[ids] * weight[:, None], np.cumsum(size) - size)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = (p @ out.T)[np.repeat(np.arange(len(rows)), size)] * weight[:, None]
            for d in range(DIM):
                vectors[:, d] -= rate * np.bincount(ids, weights=back[:, d], minlength=BUCKETS).astype(np.float32)
            out -= rate / len(rows) * (mean.T @ p)
            bias -= rate / len(rows) * p.sum(axis=0)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % FOLDS


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most `most` labelled rows outside fold 0, the first by a hash of the id."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("__y")).filter((fold() != 0) & F.col("__y").isin(0, 1))
    chosen = marked.select("doc_id", "__y", F.xxhash64("doc_id").alias("__h")).orderBy("__h", "doc_id", "__y").limit(most)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).filter(F.length("__text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id").orderBy("__h", "doc_id", "__y", "__text").limit(most).select("__text", "__y").collect()
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    return train([r[0] for r in rows], np.array([r[1] for r in rows]))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The documents with a column score, 0 to 1."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        for column in text:
            z = np.zeros(len(column))
            for lo, hi, data, offsets in W.chunks(column):
                bucket, per_word, inverse, again, w = features(data, offsets)
                each = np.add.reduceat(weights[bucket], np.cumsum(per_word) - per_word) if len(bucket) else np.zeros(0)
                doc = w.text_of_word()
                total = np.bincount(doc, weights=each[inverse], minlength=hi - lo) + again * weights[0]
                n = np.bincount(doc, weights=per_word[inverse], minlength=hi - lo) + again
                z[lo:hi] = total / np.maximum(n, 1)
            yield pa.array(1 / (1 + np.exp(-(z + bias))))
        W.release()

    return documents.withColumn("score", scored(F.coalesce(F.col("text"), F.lit(""))))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns only."""
    names = documents.columns
    plain = documents.toDF(*[f"__{i}" if n != "text" else n for i, n in enumerate(names)])
    kept = score(plain, fit(documents, labels)).filter(F.col("score") >= threshold)
    return kept.drop("score").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
