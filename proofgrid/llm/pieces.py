"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

A chunk's texts become one flat array of symbols. Words (a run of word marks and what follows) cannot merge with each
other, so each different word is encoded once; long words are cut where no piece holds the two neighbours, which no merge can
cross. Every round finds the best-ranked pair of each unfinished word (a
segmented minimum), merges its leftmost non-overlapping occurrences in all words at once, and compacts the arrays,
until no pair is left. All occurrences merge together only where no piece made from the result ranks better than it;
the few other pieces merge one occurrence a round, so the order is exactly the library's. A run of more than LONG symbols that
can't be cut, which would take very many rounds, is merged by a heap of its pairs instead, in the same order.

The library only reads the model file, on the driver; the tables (bounded by the vocabulary) are broadcast.

Defined cases: a null text is empty; an empty text has the begin and end ids and decodes to ""; each input row gives
one result row; characters outside the vocabulary become byte pieces; a very long text is encoded in one piece, in time that
grows with its length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .quality import spread
from .shared import bounded_batches

MARK, SPACE, UNKNOWN, NONE = 0x2581, 0x20, 1 << 20, np.int32(2**31 - 1)
MODEL_NAME = "piece_bpe_32k.model"
#: Words of more symbols are cut where they can be; runs of more are merged by a heap.
SPLIT, LONG = 24, 512


@dataclass
class Model:
    """Tables of a model; symbols are piece ids, and UNKNOWN + code point for other characters."""

    chars: np.ndarray  # sorted code points that are symbols
    char_ids: np.ndarray
    slots: np.ndarray  # open addressing: pair key, or -1
    slot_rank: np.ndarray
    by_rank: np.ndarray  # piece of each rank
    together: np.ndarray  # of each rank: all occurrences may merge in one round
    text: np.ndarray  # bytes of all pieces, marks as spaces
    text_at: np.ndarray
    starts_mark: np.ndarray
    byte_ids: np.ndarray
    begin: int
    end: int
    probes: int
    pairs: np.ndarray  # sorted pairs of code points that stand next to each other in a piece

    @cached_property
    def ranks(self) -> dict[int, int]:
        """Rank of each pair of symbols, for runs that are merged one pair at a time."""
        used = self.slots >= 0
        return dict(zip(self.slots[used].tolist(), self.slot_rank[used].tolist(), strict=True))


def hashed(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def load(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
    score = {p: sp.get_score(i) for p, i in pieces.items()}
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("pieces that cross words are not supported")
    symbols = dict(pieces)
    for p in pieces:
        for c in p:
            symbols.setdefault(c, UNKNOWN + ord(c))
    longer = sorted((p for p in pieces if len(p) > 1), key=lambda p: -score[p])
    rank = {p: r for r, p in enumerate(longer)}
    together, keys, ranks = np.ones(len(longer), bool), [], []
    for p in longer:
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if a in symbols and b in symbols:
                keys.append(symbols[a] << 22 | symbols[b])
                ranks.append(rank[p])
                for part in (a, b):
                    if rank.get(part, -1) > rank[p]:
                        together[rank[part]] = False
    size = 1 << 20
    slots, slot_rank, probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), 1
    for key, r, at in zip(keys, ranks, hashed(np.array(keys, np.int64), size).tolist(), strict=True):
        k = 1
        while slots[at] >= 0:
            at, k = (at + 1) & (size - 1), k + 1
        slots[at], slot_rank[at], probes = key, r, max(probes, k)
    single = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
    raw = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
    return Model(
        np.array([c for c, _ in single], np.uint32), np.array([i for _, i in single], np.int32), slots, slot_rank, np.array([pieces[p] for p in longer], np.int32), together,
        np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), np.array([not s and p.startswith("▁") for s, p in zip(special, map(sp.id_to_piece, range(n)), strict=True)]), byte_ids, sp.bos_id(), sp.eos_id(), probes,
        np.array(sorted({ord(a) << 22 | ord(b) for p in longer for a, b in zip(p, p[1:], strict=False)}), np.int64),
    )


def pair_ranks(m: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) << 22 | right
    at, size = hashed(key, len(m.slots)), len(m.slots)
    out = np.where(m.slots[at] == key, m.slot_rank[at], NONE)
    open_ = np.flatnonzero((m.slots[at] != key) & (m.slots[at] >= 0))
    for _ in range(1, m.probes):
        if not len(open_):
            break
        at[open_] = (at[open_] + 1) & (size - 1)
        seen = m.slots[at[open_]]
        hit = seen == key[open_]
        out[open_[hit]] = m.slot_rank[at[open_[hit]]]
        open_ = open_[~hit & (seen >= 0)]
    return out


def merge_words(m: Model, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols left, symbols a word) after all merges; counts: symbols of each word."""
    word = np.repeat(np.arange(len(counts)), counts)
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        rank[:-1] = np.where(word[:-1] == word[1:], pair_ranks(m, sym[:-1], sym[1:]), NONE)
    done_sym, done_word = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(starts, len(sym)))
        best = np.minimum.reduceat(rank, starts)
        over = np.repeat(best == NONE, size)
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            sym, word, rank = sym[~over], word[~over], rank[~over]
            size, best = size[best != NONE], best[best != NONE]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(best, size))
        new_run = np.concatenate([[True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])])
        in_run = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        at = at[first | (m.together[rank[at]] & (in_run & 1 == 0))]
        sym[at] = m.by_rank[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, word, rank, at = sym[keep], word[keep], rank[keep], moved[at]
        touched = np.zeros(len(sym), bool)
        touched[at] = touched[at[at > 0] - 1] = True
        again = np.flatnonzero(touched)
        inner = again[again < len(sym) - 1]
        rank[again] = NONE
        same = inner[word[inner] == word[inner + 1]]
        rank[same] = pair_ranks(m, sym[same], sym[same + 1])
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(counts))


def cut_words(m: Model, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of each run, runs of each word): long words are cut between neighbours that stand in no piece together."""
    first = np.cumsum(size) - size
    start = np.zeros(len(chars), bool)
    start[first] = True
    long = np.flatnonzero(size > SPLIT)
    if len(long) and len(m.pairs):
        i = spread(first[long] + 1, size[long] - 1)
        key = chars[i - 1].astype(np.int64) << 22 | chars[i].astype(np.int64)
        start[i[m.pairs[np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)] != key]] = True
    return np.diff(np.append(np.flatnonzero(start), len(chars))), np.add.reduceat(start.astype(np.int64), first)


def merge_long(m: Model, sym: list[int]) -> list[int]:
    """The symbols of one run after all merges: the best-ranked pair first, of equals the leftmost."""
    after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap = [(m.ranks[k], i, k) for i in range(len(sym) - 1) if (k := sym[i] << 22 | sym[i + 1]) in m.ranks]
    heapify(heap)
    while heap:
        rank, i, key = heappop(heap)
        j = after[i]
        if sym[i] < 0 or j >= len(sym) or sym[i] << 22 | sym[j] != key:
            continue
        sym[i], sym[j], after[i] = int(m.by_rank[rank]), -1, after[j]
        if after[i] < len(sym):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(sym) and (k := sym[a] << 22 | sym[b]) in m.ranks:
                heappush(heap, (m.ranks[k], a, k))
    return [x for x in sym if x >= 0]


def merged(m: Model, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge_words, with long runs merged before."""
    if len(long := np.flatnonzero(counts > LONG)):
        at, parts = np.cumsum(counts), []
        counts, done = counts.copy(), 0
        for i in long:
            run = merge_long(m, sym[at[i] - counts[i] : at[i]].tolist())
            parts += [sym[done : at[i] - counts[i]], np.array(run, np.int32)]
            done, counts[i] = at[i], len(run)
        sym = np.concatenate([*parts, sym[done:]])
    return merge_words(m, sym, counts)


def to_bytes(m: Model, sym: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary as byte pieces: (ids, ids a word)."""
    code = sym - UNKNOWN
    n = np.where(code < 0, 1, np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))))
    out, at = np.repeat(sym, n), np.cumsum(n) - n
    for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        i = np.flatnonzero((code >= 0) & (n == size))
        for k in range(size):
            rest = code[i] >> (6 * (size - 1 - k))
            out[at[i] + k] = m.byte_ids[(rest | lead) if k == 0 else (0x80 | rest & 0x3F)]
    return out, np.bincount(np.repeat(word, n), minlength=words)


def distinct_words(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different word, which of them each word is); words are all of flat. Words are brought together by a hash and then compared
    character by character; those that only share a hash are told apart by their characters."""
    _, index, inverse = np.unique(W.span_hashes(flat.view(np.uint8), 4 * starts, 4 * (starts + size)), return_index=True, return_inverse=True)
    same = flat == flat[np.minimum(spread(starts[index][inverse], size), len(flat) - 1)]
    other = np.flatnonzero(~np.logical_and.reduceat(same, starts) | (size != size[index][inverse]))
    known: dict[bytes, int] = {}
    more = []
    for i in other.tolist():
        word = flat[starts[i] : starts[i] + size[i]].tobytes()
        if word not in known:
            known[word] = len(index) + len(more)
            more.append(i)
        inverse[i] = known[word]
    return np.append(index, more).astype(np.int64), inverse


def encode(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, with begin and end ids, ids a text) of a chunk of UTF-8 texts."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    full = np.flatnonzero(np.diff(at) > 0)
    flat = np.insert(np.where(code == SPACE, np.uint32(MARK), code), at[full], np.uint32(MARK))
    begin = at[full] + np.arange(len(full))
    is_mark = flat == MARK
    starts_word = is_mark & ~np.concatenate([[False], is_mark[:-1]])
    starts_word[begin] = True
    starts = np.flatnonzero(starts_word)
    size = np.diff(np.append(starts, len(flat)))
    if not len(starts):
        n = len(offsets) - 1
        return np.tile(np.array([m.begin, m.end], np.int32), n), np.full(n, 2)
    index, inverse = distinct_words(flat, starts, size)
    chars = flat[spread(starts[index], size[index])]
    where = np.minimum(np.searchsorted(m.chars, chars), len(m.chars) - 1)
    sym = np.where(m.chars[where] == chars, m.char_ids[where], UNKNOWN + chars.astype(np.int32)).astype(np.int32)
    runs, runs_a_word = cut_words(m, chars, size[index])
    sym, per = merged(m, sym, runs)
    per = np.add.reduceat(per, np.cumsum(runs_a_word) - runs_a_word)
    sym, per = to_bytes(m, sym, np.repeat(np.arange(len(per)), per), len(per))
    first = np.cumsum(per) - per
    per_word = per[inverse]
    ids = sym[spread(first[inverse], per_word)]
    text = np.searchsorted(begin, starts, "right") - 1
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[full] = np.bincount(text, weights=per_word, minlength=len(full)).astype(np.int64)
    total = counts + 2
    out = np.full(total.sum(), m.begin, np.int32)
    first = np.cumsum(total) - total
    out[first + total - 1] = m.end
    out[spread(first + 1, counts)] = ids
    return out, total


def decode(m: Model, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of ids: one leading space goes, a byte outside any character becomes U+FFFD."""
    size = (m.text_at[1:] - m.text_at[:-1])[ids]
    first = m.text_at[:-1][ids].copy()
    text = np.repeat(np.arange(len(counts)), counts)
    real = np.flatnonzero(size > 0)
    if len(real):
        lead = real[np.concatenate([[True], text[real[1:]] != text[real[:-1]]])]
        lead = lead[m.starts_mark[ids[lead]]]
        first[lead] += 1
        size[lead] -= 1
    data = m.text[spread(first, size)]
    at = np.concatenate([[0], np.cumsum(np.bincount(text, weights=size, minlength=len(counts)))]).astype(np.int64)
    raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
    try:
        return pc.cast(raw, pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([repaired(x) for x in raw.to_pylist()], pa.large_string())


def repaired(raw: bytes) -> str:
    out = ""
    while raw:
        try:
            return out + raw.decode("utf-8")
        except UnicodeDecodeError as e:
            out, raw = out + raw[: e.start].decode("utf-8") + "�", raw[e.start + 1 :]
    return out


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row; ids are little-endian 32-bit numbers."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(load(path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offsets in W.chunks(b.column("text"), 1 << 20):
                ids, counts = encode(m, data, offsets)
                at = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), raw, decode(m, ids, counts).cast(pa.string())], ["doc_id", "ids", "decoded"])
        W.release()

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL_NAME)
    t = tokenized(documents, path)
    return t.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
