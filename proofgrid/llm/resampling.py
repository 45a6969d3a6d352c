"""Importance resampling towards a target: documents weighed by hashed runs of words against a benchmark, drawn with Gumbel noise.

Identical texts are grouped by their full text; each different text is read once: the buckets of its features (runs of 1 to RUN words)
are written, counted over the corpus times the text's copies, and weighed by the buckets' gains. The weight goes back to all documents
by a digest of the text; only then comes the noise, which is the document's own. The draw is the first part of a global order, ranked
by ranges.

Defined cases: a null or empty text has no feature and weight 0, and is not among the documents that can be drawn; a null id counts as the
empty string for the noise and comes last among ties; repeated rows are ranked one by one; a very long text counts whole; an empty table
gives no row, an empty target the gains of no target feature; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .quality import spread
from .ranges import counted_join, ranked
from .shared import bounded_batches, materialize

SEED, BUCKETS, LEAST_WORDS, PERCENT = 7, 10_000, 20, 25
#: Words of more bytes are read one by one.
LONG = 64
KIND = W.byte_class(lower=True, alphanumeric=True)


def zero_steps(crc: np.ndarray) -> np.ndarray:
    """A checksum's register after one more zero byte."""
    return TABLE[crc & 0xFF] ^ (crc >> np.uint32(8))


TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear, so the difference from a zero byte is the table
#: AFTER[n][k][b]: what byte k of a register, b, is after n zero bytes; so a checksum can be moved over a word without reading it.
AFTER = np.zeros((LONG + 1, 4, 256), np.uint32)
AFTER[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
for _n in range(LONG):
    AFTER[_n + 1] = zero_steps(AFTER[_n])


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the bytes data[starts[i]:ends[i]] for every i, a byte of all words a step."""
    size = ends - starts
    order = np.argsort((LONG - np.minimum(size, LONG)).astype(np.uint8), kind="stable")
    at, left = starts[order], np.minimum(size, LONG)[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(left)
    for k in range(int(left.max(initial=0))):
        live = np.searchsorted(-left[:live], -k)
        crc[:live] = TABLE[(crc[:live] ^ data[at[:live] + k]) & 0xFF] ^ (crc[:live] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def pair_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 of word i, a space and word i + 1 for every i but the last."""
    left = ~crc[:-1]
    left = ~(TABLE[(left ^ 0x20) & 0xFF] ^ (left >> np.uint32(8)))
    size = (ends - starts)[1:]
    step = AFTER[np.minimum(size, LONG)[:, None], np.arange(4)[None, :], (left[:, None] >> (8 * np.arange(4, dtype=np.uint32))[None, :]) & 0xFF]
    out = np.bitwise_xor.reduce(step, axis=1) ^ crc[1:]
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[starts[i + 1] : ends[i + 1]].tobytes(), int(left[i]))
    return out


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, features a text) of a chunk of texts."""
    w = W.Words(data, offsets, KIND)
    low = W.LOWER[w.data]
    crc = checksums(low, w.starts, w.ends)
    count = w.counts + np.maximum(w.counts - 1, 0)
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint16)
    out[spread(first, w.counts)] = crc % BUCKETS
    if len(crc) > 1:
        text = w.text_of_word()
        pairs = pair_checksums(low, w.starts, w.ends, crc)[text[1:] == text[:-1]]
        out[spread(first + w.counts, np.maximum(w.counts - 1, 0))] = pairs % BUCKETS
    return out, count


def featured(texts: DataFrame) -> DataFrame:
    """(key, copies, n_features, buckets) of each different text (key, copies, text), written; buckets are numbers of two bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in W.chunks(b.column("text")):
                found, n = buckets(data, offsets)
                raw = memoryview(found.tobytes())
                ends = 2 * np.cumsum(n)
                rows = pa.array([bytes(raw[e - 2 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), b.column("copies").slice(lo, hi - lo), pa.array(n.astype(np.int64)), rows], ["key", "copies", "n_features", "buckets"])
        W.release()

    return materialize(texts.select("key", "copies", "text").mapInArrow(run, "key binary, copies long, n_features long, buckets binary"), "features", "zstd")


def distinct_texts(table: DataFrame) -> DataFrame:
    """(key, copies, text): the different texts, with how many rows have each. Copies meet in each task before they are shuffled."""
    bounded_batches(table.sparkSession)
    one = table.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return one.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")


def flat(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in b.column("buckets")), np.uint16)


def totals(features: DataFrame) -> np.ndarray:
    """Features in each bucket, copies counted. A task gives a row for each bucket at most; the driver gets BUCKETS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BUCKETS, np.int64)
        for b in batches:
            each = np.repeat(b.column("copies").to_numpy(), b.column("n_features").to_numpy())
            out += np.bincount(flat(b), weights=each, minlength=BUCKETS).astype(np.int64)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in features.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, floored."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, copies, n_features, weight) of each different text, written: the floored mean of its features' gains."""
    shared = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(shared.value[flat(b)])])
            ends = np.cumsum(n)
            mean = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), b.column("n_features"), pa.array(mean)], ["key", "copies", "n_features", "weight"])

    return materialize(features.mapInArrow(run, "key binary, copies long, n_features long, weight long"), "weights")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of documents; rank 1, 2, 3, ... of the drawn percent of those with enough words, else null."""
    features = featured(distinct_texts(documents))
    weights = weighed(features, gains(totals(features), totals(featured(distinct_texts(target)))))
    rows = documents.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("key"))
    n_rows = weights.agg(F.sum("copies")).first()[0] or 0
    x = counted_join(rows, weights, "key", "copies", n_rows, "doc_id", "key")
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0)))
    x = x.withColumn("score", F.col("weight") + noise.cast("long"))
    able = F.floor((F.col("n_features") + 1) / 2) >= least_words  # n words have 2 n - 1 features
    n_able = weights.filter(able).agg(F.sum("copies")).first()[0] or 0
    drawn = n_able * percent // 100
    r = ranked(x.withColumn("__able", able), F.desc("__able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"))
    return r.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
r AS (SELECT row_number() OVER () AS row, doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
fd AS (SELECT row, feature, count(*) AS n FROM (SELECT row, unnest(f) AS feature FROM r) GROUP BY ALL),
fb AS (SELECT feature, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM b) GROUP BY ALL),
k AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT feature FROM fd UNION SELECT feature FROM fb)),
h AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
             lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM k, crc),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM fd JOIN h USING (feature) GROUP BY 1), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM fb JOIN h USING (feature) GROUP BY 1),
z AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::BIGINT AS s_all, coalesce((SELECT sum(t) FROM t), 0)::BIGINT AS t_all),
g AS (SELECT i AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
      FROM range(10000) AS q(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i, z),
m AS (SELECT row, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM fd JOIN h USING (feature) JOIN g USING (bucket) GROUP BY 1),
w AS (SELECT r.row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((total - (total % n + n) % n) // n, 0)::BIGINT AS weight, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM r LEFT JOIN m ON m.row = r.row),
v AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', sha[i]) - 1)::BIGINT)), lambda a, c: a * 16 + c) AS hash FROM w),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((hash + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, (25 * count(*) FILTER (words >= 20) OVER ()) // 100 AS drawn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM y
"""
