"""Packing: all documents end to end, cut into sequences of a fixed number of tokens.

Pass one tokenizes: each task writes its documents' ids with the tokens before them in the task, and the totals of all tasks are summed up
to global offsets. Pass two only cuts: a window of the global row of tokens is a sequence, and a document's piece is what it has in
one window. No text and no id is shuffled; only windows that lie across the end of a batch are put together from boundary records.

Ids are those of the `tokenizers` library: texts are encoded by the same merges in `tiktoken` where the tokenizer is plain byte-level
byte-pair encoding (checked when it is loaded) and the text has none of its added tokens, else by `tokenizers` itself.

Defined cases: a null or empty text is the end token alone; a document longer than a sequence has pieces in many; repeated rows are packed as often
as they stand; a null id stays null; an empty table gives no piece; other columns are ignored. The order is that of the input's partitions.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .quality import spread
from .shared import bounded_batches, materialize

MODEL_NAME, END, SIZE = "byte_bpe_50k.json", 0, 1024
#: Characters of texts that are encoded before their ids are handed on.
CHARS = 1 << 21


def byte_names() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, where ids follow the order of merges and nothing but byte-level splitting comes before; else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    names, vocab, added = byte_names(), model["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = {t: i for t, i in vocab.items() if t not in added}
    if made != sorted(set(made)) or len(plain) != 256 + len(made) or any(i >= made[0] for t, i in plain.items() if len(t) == 1):
        return None
    return {bytes(names[c] for c in t): i for t, i in plain.items()}


@lru_cache(maxsize=1)
def encoder(model: str) -> tuple[Callable[[list[str]], list], type]:
    """(texts to lists of ids, the type that holds an id) of a tokenizer's JSON; once a worker."""
    import tokenizers

    tok = tokenizers.Tokenizer.from_str(model)
    spec = json.loads(tok.to_str())
    ranks, added = plain_ranks(spec), [t["content"] for t in spec["added_tokens"]]
    kind = np.uint16 if tok.get_vocab_size(True) <= 1 << 16 else np.uint32
    whole = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    if ranks is None:
        return whole, kind
    import public_tokenizers
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [whole([t])[0] if any(a in t for a in added) else plain.encode_ordinary(t) for t in texts], kind


def tokenized(documents: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, part, before, n, ids) of every row, written: part is the task, before the tokens before the document there, ids little-endian numbers of 2 bytes
    (4 where the vocabulary asks for it), the end token included."""
    bounded_batches(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    with open(path, encoding="utf-8") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(model.value)
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, data, offsets in W.chunks(b.column("text"), CHARS):
                texts = [bytes(data[i:j]).decode() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                ids = [np.array([*x, end], kind) for x in encode(texts)]
                n = np.array([len(x) for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(at), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "part", "before", "n", "ids"])
        W.release()

    return materialize(documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, part int, before long, n long, ids binary"), "tokens", "zstd")


def bases(tokens: DataFrame) -> np.ndarray:
    """The global offset at which each part starts: one number for each task of pass one."""
    total = sorted(tokens.groupBy("part").agg(F.sum("n")).collect())
    out = np.zeros(total[-1][0] + 2 if total else 1, np.int64)
    for part, n in total:
        out[part + 1] = n
    return np.cumsum(out)


def flat(b: pa.RecordBatch, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(global start and length of each row, ids of all rows) of a batch of tokenized()."""
    n = b.column("n").to_numpy()
    start = base[b.column("part").to_numpy()] + b.column("before").to_numpy()
    raw = b"".join(x.as_buffer() for x in b.column("ids"))
    return start, n, np.frombuffer(raw, np.uint16 if len(raw) == 2 * n.sum() else np.uint32).astype("<u4")


def cut(start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, sequence, from, to) of every piece of rows that hold the global tokens start to start + n; from and to are global."""
    first = start // size
    pieces = (start + n - 1) // size - first + 1
    row = np.repeat(np.arange(len(n)), pieces)
    sequence = spread(first, pieces)
    return row, sequence, np.maximum(start[row], sequence * size), np.minimum((start + n)[row], (sequence + 1) * size)


def pieces(tokens: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece: start counts in the document, offset in the sequence."""
    shared = tokens.sparkSession.sparkContext.broadcast(bases(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, n, ids = flat(b, shared.value)
            row, sequence, lo, hi = cut(start, n, size)
            at = (np.cumsum(n) - n - start)[row] + lo
            raw, length = memoryview(ids.tobytes()), hi - lo
            crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *map(pa.array, (lo - start[row], length, np.array(crc, np.int64), n[row], sequence, lo - sequence * size))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        W.release()

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(tokens: DataFrame, size: int = SIZE) -> DataFrame:
    """(sequence_id, ids, n_tokens, padded): the sequences, ids as little-endian numbers of 4 bytes. padded is the length to which a trainer pads: size, but
    a last sequence whose length is a power of two stays so long."""
    shared = tokens.sparkSession.sparkContext.broadcast(bases(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            start, n, ids = flat(b, shared.value)
            new = np.concatenate([[True], start[1:] != (start + n)[:-1]])  # rows that follow each other in the global row of tokens are one run
            at = np.flatnonzero(new)
            _, sequence, lo, hi = cut(start[at], np.add.reduceat(n, at), size)
            raw, ends = memoryview(ids.tobytes()), np.cumsum(hi - lo)
            rows = [bytes(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), (hi - lo).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sequence), pa.array(lo - sequence * size), pa.array(rows, pa.binary())], ["sequence_id", "offset", "ids"])

    cuts = materialize(tokens.mapInArrow(run, "sequence_id long, offset long, ids binary"), "cuts", "zstd")
    whole = F.octet_length("ids") == 4 * size
    boundary = cuts.filter(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = boundary.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"))
    n = F.octet_length("ids") / 4
    every = cuts.filter(whole).select("sequence_id", "ids").unionByName(joined).withColumn("n_tokens", n.cast("long"))
    return every.withColumn("padded", F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(size).cast("long")))


def packed(documents: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """The pieces of all documents; path: the tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL_NAME)
    return pieces(tokenized(documents, path), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
