"""Benchmark decontamination by winnowing.

Both tables keep the minimum hash of every run of `window - gram + 1` word k-grams, so a shared span of `window` words
always shares a kept fingerprint at the same place. The fingerprints are joined, and each hit is extended word by word.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after folding A-Z. An item of fewer than `window` words is one window.

Defined cases: a null or empty text has no words and no hits; null ids are kept as they are; items
without an id hit like others, count as one item together and add nothing to items_sha256; each input row gives one result
row, also repeated ones; items without words are ignored; an empty benchmark hits nothing; a very long text is read in one
piece, a text at a time; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import broadcast_if_small, id_key, materialize, may_be_in, renamed, text_key

WINDOW, GRAM = 10, 5
#: Entries of the filter that fingerprints of documents pass before the join; its size does not depend on the data.
FILTER_BITS = 1 << 22


def winnow(grams: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some run of width grams, ties included; ok marks valid starts of runs."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = np.where(ok[: len(grams) - width + 1], W.sliding_min(grams, width), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((~W.sliding_min(~padded, width) == grams) & (grams > 0))


def around(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, before: int, total: int) -> np.ndarray:
    """Rows of total word hashes from before words ahead of at; 0 outside the text."""
    idx = at[:, None] + np.arange(-before, total - before)[None, :]
    inside = (idx >= 0) & (idx < len(hashes))
    idx = np.clip(idx, 0, max(len(hashes) - 1, 0))
    return np.where(inside & (doc[idx] == doc[at][:, None]), hashes[idx], np.uint64(0))


def fingerprints(column: pa.Array, window: int, gram: int, short: list[int], bits: np.ndarray | None, items: bool, secret: int):
    """(row of text, words of text, per fingerprint: text, hash, position, length, context) by chunks."""
    kind, size = W.byte_class(True, True), 2 * window - gram
    for lo, hi, data, offsets in W.chunks(column):
        w = W.Words(data, offsets, kind)
        h, doc = w.hashes(secret), w.text_of_word()
        found = []
        g = W.grams(h, gram)
        at = winnow(g, W.within(w.first, window, len(g)), window - gram + 1)
        found.append((at, g[at] if len(at) else np.zeros(0, np.uint64), gram))
        for m in short:
            g = W.grams(h, m)
            ok = W.within(w.first, m, len(g))
            if items:
                whole = np.flatnonzero(w.counts == m)
                ok &= np.isin(np.arange(len(g)), w.first[:-1][whole])
            at = np.flatnonzero(ok)
            found.append((at, g[at], -m))
        at, fp, length = (np.concatenate(x) for x in zip(*[(a, f, np.full(len(a), k, np.int32)) for a, f, k in found], strict=True))
        if bits is not None:
            slot = fp % np.uint64(len(bits) * 8)
            keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, fp, length = at[keep], fp[keep], length[keep]
        order = np.argsort(doc[at], kind="stable") if len(at) else at
        at, fp, length = at[order], fp[order], length[order]
        ctx = around(h, doc, at, window - gram, size) if len(at) else np.zeros((0, size), np.uint64)
        yield lo, hi, w, doc[at] if len(at) else at, fp.view(np.int64), at - w.first[:-1][doc[at]] if len(at) else at, length, ctx


def binary_rows(ctx: np.ndarray) -> pa.Array:
    size = ctx.shape[1] * 8
    at = pa.py_buffer((np.arange(len(ctx) + 1, dtype=np.int32) * size).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ctx), [None, at, pa.py_buffer(np.ascontiguousarray(ctx).tobytes())])


def benchmark_fingerprints(benchmark: DataFrame, window: int, gram: int, secret: int) -> DataFrame:
    """(fp, item_id, length, item_ctx) of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id")
            for lo, _, _, doc, fp, _, length, ctx in fingerprints(b.column("text"), window, gram, list(range(1, window)), None, True, secret):
                yield pa.RecordBatch.from_arrays([pa.array(fp), ids.take(pa.array(doc + lo)), pa.array(length, pa.int32()), binary_rows(ctx)], ["fp", "item_id", "length", "item_ctx"])

    return items.mapInArrow(run, "fp long, item_id string, length int, item_ctx binary").distinct()


def filter_bits(fps: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits, built by a distributed bit_or; at most FILTER_BITS / 32 numbers reach the driver."""
    slot = F.expr(f"cast(fp as decimal(20, 0)) + if(fp < 0, 18446744073709551616, 0)") % FILTER_BITS
    parts = fps.select(slot.cast("long").alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("b")).collect()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, b in parts:
        out[w] = b & 0xFFFFFFFF
    return out.view(np.uint8)


def scanned(documents: DataFrame, fps: DataFrame, window: int, gram: int, secret: int) -> DataFrame:
    """(k1, k2, doc_id, n_words, found) of every row of documents; found: its fingerprints that items may have."""
    spark = documents.sparkSession
    short = sorted(-r[0] for r in fps.filter("length < 0").select("length").distinct().collect())
    bits = spark.sparkContext.broadcast(filter_bits(fps))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), id_key(), text_key())
    out = "k1 long, k2 long, doc_id {}, n_words long, found array<struct<fp: long, pos: int, length: int, ctx: binary>>".format(documents.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w, doc, fp, pos, length, ctx in fingerprints(b.column("text"), window, gram, short, bits.value, False, secret):
                part = b.slice(lo, hi - lo)
                entry = pa.StructArray.from_arrays([pa.array(fp), pa.array(pos, pa.int32()), pa.array(length, pa.int32()), binary_rows(ctx)], ["fp", "pos", "length", "ctx"])
                at = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=hi - lo), out=at[1:])
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), entry)], ["k1", "k2", "doc_id", "n_words", "found"])

    return materialize(docs.mapInArrow(run, out), "document-fingerprints")


def hits(rows: DataFrame, fps: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, k2, item_id, a, b): words a to b of the document stand in item_id, which may be null. Repeated rows count once."""
    each = rows.filter(F.size("found") > 0).select("k1", "k2", F.explode("found").alias("f")).select("k1", "k2", "f.*").distinct()
    joined = each.join(broadcast_if_small(fps), ["fp", "length"]).select("k1", "k2", "pos", "length", "ctx", "item_ctx", "item_id")
    before, size = window - gram, 2 * window - gram

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, pos = b.column("length").to_numpy(), b.column("pos").to_numpy().astype(np.int64)
            mine, theirs = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, size) for c in ("ctx", "item_ctx"))
            same = (mine == theirs) & (mine != 0)
            left = np.cumprod(same[:, :before][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, before + gram :], axis=1).sum(axis=1)
            hit = np.where(length > 0, same[:, before : before + gram].all(axis=1) & (left + gram + right >= window), same[:, before])
            a = np.where(length > 0, pos - left, pos)
            z = np.where(length > 0, pos + gram + right, pos - length)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "item_id")), pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["k1", "k2", "item_id", "a", "b"]).filter(pa.array(hit))

    return joined.mapInArrow(extend, "k1 long, k2 long, item_id string, a int, b int")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, doc_id, n_words, n_hit, items sorted, n_items with the null one, spans): one row for each row of documents."""
    secret = W.draw()
    fps = materialize(benchmark_fingerprints(benchmark, window, gram, secret), "benchmark-fingerprints")
    rows = scanned(documents, fps, window, gram, secret)
    union = "aggregate(spans, struct(0L as n, 0L as upto), (s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.upto)) as n, greatest(s.upto, cast(x.b as long)) as upto)).n"
    found = hits(rows, fps, window, gram).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.expr("cast(size(collect_set(item_id)) + max(if(item_id is null, 1, 0)) as long)").alias("n_items"), F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    out = rows.drop("found").join(found, ["k1", "k2"], "left")
    return out.select("k1", "k2", "doc_id", "n_words", F.coalesce(F.expr(union), F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "spans")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a word of a benchmark window, with all their columns; repeated rows stay. Rows that can't be hit pass by
    the join without a shuffle."""
    bad = materialize(contamination(documents, benchmark).filter("n_hit > 0").select("k1", "k2").distinct(), "hit-documents")
    plain, names = renamed(documents, "doc_id", "text")
    touched, rest = may_be_in(plain.withColumns({"k1": id_key(), "k2": text_key()}), bad, "k1", "k2")
    return rest.unionByName(touched.join(bad, ["k1", "k2"], "left_anti")).select(*plain.columns).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT d.doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
