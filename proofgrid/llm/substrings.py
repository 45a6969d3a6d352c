"""Substring deduplication with suffix automata of reference shards.

A word goes when a window of 50 words that covers it also starts in a document with a smaller id. The reference is the
corpus itself, so it is cut into shards of bounded size, and each shard's automaton goes to the tasks that stream the
documents which can match it:

1. Every document keeps the minimum 8-gram hash of each window (an anchor); equal windows have equal anchors. Windows whose
   anchor one document alone has are settled there.
2. The other windows are fingerprinted; of each fingerprint the smallest document that has it is the source. What sources hold
   of repeated windows is the reference: pieces of at most 2**PIECE_BITS windows, dealt by hash into shards of about SHARD words.
3. Fingerprints only choose the shards a document is streamed through, and the range of its words. Each task builds the
   suffix automaton of a shard's pieces, every state with the smallest id it comes from, streams the documents' words and
   takes every match of 50 words whose state has a smaller id. A shard that very many words go through is sent to more tasks.

Defined cases: a null text has no words; a null id sorts after all others; rows with equal id never remove each other's
words; each input row gives one result row, also repeated ones; a very long text is anchored in one piece and streamed through
each of its shards by range; an empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import discard, id_key, materialize, may_be_in, partitions, renamed, text_key

WINDOW, ANCHOR = 50, 8
#: Places of a cell: of sources, whose windows in one are a piece, and of documents, whose windows in one are a range; powers of 2.
PIECE_BITS, RANGE_BITS = 9, 12
#: Words of a shard's pieces, and of documents that one task streams through it, both about.
SHARD, STREAM = 32_768, 65_536


class Automaton:
    """Suffix automaton of several word sequences, each with a number; a state knows the smallest number it comes from."""

    def __init__(self, sequences: list[tuple[int, list[bytes]]]):
        self.go, self.link, self.size, self.least = [{}], [-1], [0], [2**63 - 1]
        for number, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word, number)
        # what ends in a state also ends in its suffixes
        for at in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[at]
            self.least[up] = min(self.least[up], self.least[at])

    def _extend(self, last: int, word: bytes, number: int) -> int:
        go, link, size = self.go, self.link, self.size
        to = go[last].get(word)
        if to is not None and size[to] == size[last] + 1:
            self.least[to] = min(self.least[to], number)
            return to
        new = None
        if to is None:
            new, at = self._state({}, 0, size[last] + 1, number), last
            while at >= 0 and word not in go[at]:
                go[at][word] = new
                at = link[at]
            if at < 0:
                return new
            to = go[at][word]
        else:
            at = last
        if size[to] != size[at] + 1:
            twin = self._state(dict(go[to]), link[to], size[at] + 1, 2**63 - 1)
            while at >= 0 and go[at].get(word) == to:
                go[at][word] = twin
                at = link[at]
            link[to] = twin
            to = twin
        if new is None:
            self.least[to] = min(self.least[to], number)
            return to
        link[new] = to
        return new

    def _state(self, go: dict, link: int, size: int, least: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        self.least.append(least)
        return len(self.go) - 1

    def matches(self, words: list[bytes], least: int, number: int) -> list[tuple[int, int]]:
        """Maximal spans [a, b) of words that matches of exactly least words from sequences of smaller numbers cover."""
        go, link, size, known = self.go, self.link, self.size, self.least
        out, at, have = [], 0, 0
        for i, word in enumerate(words):
            while at and word not in go[at]:
                at = link[at]
                have = size[at]
            if word in go[at]:
                at, have = go[at][word], have + 1
            while at and size[link[at]] >= least:  # the state of the last words, as many as count
                at = link[at]
                have = size[at]
            if have >= least and known[at] < number:
                a = i + 1 - least
                if out and out[-1][1] >= a:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((a, i + 1))
        return out


def window_minima(w: W.Words, window: int, anchor: int, secret: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, start of every window, its anchor)."""
    h = w.hashes(secret)
    g = W.grams(h, anchor)
    if len(h) < window:
        return h, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = W.sliding_min(g, window - anchor + 1)
    at = np.flatnonzero(W.within(w.first, window, len(low)))
    return h, at, low[at]


def anchors(docs: DataFrame, window: int, anchor: int, secret: int) -> DataFrame:
    kind = W.byte_class(False, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1 = b.column("k1").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in W.chunks(b.column("text")):
                w = W.Words(data, offsets, kind)
                _, at, low = window_minima(w, window, anchor, secret)
                if len(at):
                    doc = w.text_of_word()[at]
                    new = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
                    low, doc = low[new], doc[new]
                    order = np.lexsort((low, doc))
                    low, doc = low[order], doc[order]
                    new = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(k1[lo + doc[new]])], ["anchor", "k1"])

    return docs.select("k1", "text").mapInArrow(run, "anchor long, k1 long")


def candidates(docs: DataFrame, window: int, anchor: int, secret: int) -> DataFrame:
    """Rows of documents with shared anchors: (k1, tag, fps, pos, first, segs); first: no earlier window of the row is
    equal; segs: the text that the windows cover. Places start at tag."""
    kind = W.byte_class(False, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("anchors")
            for lo, hi, data, offsets in W.chunks(b.column("text")):
                w = W.Words(data, offsets, kind)
                h, at, low = window_minima(w, window, anchor, secret)
                part = known.slice(lo, hi - lo)
                flat = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                salt = W.mix(np.arange(1, hi - lo + 1, dtype=np.uint64))
                doc = w.text_of_word()
                hit = np.isin(low ^ salt[doc[at]], flat ^ salt[owner]) if len(at) and len(flat) else np.zeros(len(at), bool)
                at = at[hit]
                fp = W.grams(h, window)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                doc = doc[at] if len(at) else at
                counts = np.bincount(doc, minlength=hi - lo)
                order = np.lexsort((fp, doc))
                new = np.concatenate([np.ones(min(1, len(fp)), bool), (fp[order][1:] != fp[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
                first = np.zeros(len(fp), bool)
                first[order[new]] = True
                tag = b.column("tag").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                pos = at - w.first[:-1][doc] + tag[doc] if len(at) else at
                segs: list[list[tuple[int, str]]] = [[] for _ in range(hi - lo)]
                if len(at):
                    cut = np.flatnonzero(np.concatenate([[True], (at[1:] > at[:-1] + window) | (doc[1:] != doc[:-1])]))
                    for a, z in zip(cut, np.append(cut[1:], len(at)) - 1, strict=True):
                        segs[doc[a]].append((int(pos[a]), data[w.starts[at[a]] : w.ends[at[z] + window - 1]].tobytes().decode()))
                some = counts > 0
                own = b.slice(lo, hi - lo).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [own.column("k1"), own.column("tag"), W.lists(fp, counts[some], pa.int64()), W.lists(pos, counts[some], pa.int64()), W.lists(first, counts[some], pa.bool_()), pa.array([s for s in segs if s], pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string())])))],
                    ["k1", "tag", "fps", "pos", "first", "segs"],
                )

    return docs.select("k1", "tag", "text", "anchors").mapInArrow(run, "k1 long, tag long, fps array<long>, pos array<long>, first array<boolean>, segs array<struct<start: long, text: string>>")


def wanted_words(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of wanted ranges (shard, k1, start, stop, reference) of documents' places, start inclusive."""
    names = ["shard", "k1", "start", "reference", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for k1, segs, want in zip(*(b.column(c).to_pylist() for c in ("k1", "segs", "want")), strict=True):
                pieces = [(s["start"], s["text"].encode().split()) for s in segs]
                for x in want:
                    for start, words in pieces:  # a range may span several, or stand in another row of the same id
                        a, z = max(x["start"], start), min(x["stop"], start + len(words))
                        if z > a:
                            out.append((x["shard"], k1, a, x["reference"], b" ".join(words[a - start : z - start]).decode()))
                            held += len(out[-1][-1])
                            if held > W.CHUNK_BYTES:
                                yield batch(out)
                                out, held = [], 0
            if out:
                yield batch(out)

    one = wanted.groupBy("k1").agg(F.collect_set(F.struct("shard", "start", "stop", "reference")).alias("want"))
    return found.select("k1", "segs").join(one, "k1").mapInArrow(run, "shard long, k1 long, start long, reference boolean, words string")


def statistics(words: DataFrame, window: int) -> DataFrame:
    """(k1, a, b): places that a match of window words in a source with a smaller id covers. A task has a shard's pieces first, builds their
    automaton, and streams documents through it; shards with many words to stream have several parts, each with the pieces."""
    load = words.groupBy("shard").agg(F.sum(F.when(~F.col("reference"), F.length("words") / 6 + 1)).alias("load"))
    parts = load.select("shard", F.least(F.ceil(F.coalesce("load", F.lit(0.0)) / STREAM) + F.when(F.col("load") > 0, 0).otherwise(1), F.lit(2**20)).cast("int").alias("parts"))
    dealt = words.join(parts, "shard")
    each = F.when(F.col("reference"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("k1", "start"), F.col("parts")).cast("int")))
    dealt = dealt.select("shard", F.explode(each).alias("part"), "reference", "k1", "start", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, automaton, last = None, [], None, None
        for b in batches:
            out = []
            for shard, part, reference, k1, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (shard, part) != now:
                    now, pieces, automaton, last = (shard, part), [], None, None
                if last == (reference, k1, start):
                    continue  # of a repeated row
                last = (reference, k1, start)
                if reference:
                    pieces.append((k1, text.encode().split()))
                    continue
                if automaton is None:
                    automaton, pieces = Automaton(pieces), []
                out += [(k1, start + x, start + y) for x, y in automaton.matches(text.encode().split(), window, k1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["k1", "a", "b"])

    order = dealt.repartition(partitions(words.sparkSession), "shard", "part").sortWithinPartitions("shard", "part", F.desc("reference"), "k1", "start")
    return order.mapInArrow(run, "k1 long, a long, b long")


def tag(k2: str = "k2"):
    """Where the places of a row's words start: rows that share an id have different texts, so other places."""
    return F.shiftleft(F.col(k2).bitwiseAND(F.lit(2**30 - 1)), 32)


def repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(k1, gone): the word spans that go, by id; places start at the row's tag."""
    docs = documents.select(id_key(), text_key(), F.col("text").cast("string").alias("text"))
    secret = W.draw()
    rows = materialize(anchors(docs, window, anchor, secret), "anchors")
    many = rows.groupBy("anchor").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo < hi").select("anchor")
    known = materialize(rows.join(many, "anchor").groupBy("k1").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    discard(rows)
    able = may_be_in(docs, known.select("k1"), "k1")[0]
    found = materialize(candidates(able.select("k1", tag().alias("tag"), "text").join(known, "k1"), window, anchor, secret), "windows")
    discard(known)
    w = found.select("k1", F.explode(F.arrays_zip("fps", "pos", "first")).alias("w")).select("k1", F.col("w.fps").alias("fp"), F.col("w.pos").alias("pos"), F.col("w.first").alias("first"))
    source = w.filter("first").groupBy("fp").agg(F.min("k1").alias("s1"), F.max("k1").alias("hi"), F.min_by("pos", "k1").alias("s_pos")).filter("s1 < hi")
    source = materialize(source.select("fp", "s1", "s_pos"), "sources")
    piece = F.shiftright("s_pos", PIECE_BITS)
    refs = source.groupBy(F.col("s1").alias("k1"), piece.alias("cell")).agg(F.min("s_pos").alias("start"), (F.max("s_pos") + window).alias("stop"))
    shards = 1 + (refs.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0) // SHARD
    shard = lambda k1, cell: F.pmod(F.xxhash64(k1, cell), F.lit(shards)).alias("shard")
    refs = refs.select(shard("k1", "cell"), "k1", "start", "stop", F.lit(True).alias("reference"))
    hits = w.join(source, "fp").filter("k1 > s1").groupBy(shard("s1", piece), "k1", F.shiftright("pos", RANGE_BITS).alias("cell")).agg(F.min("pos").alias("start"), (F.max("pos") + window).alias("stop"))
    wanted = materialize(refs.unionByName(hits.select("shard", "k1", "start", "stop", F.lit(False).alias("reference"))), "ranges")
    discard(source)
    words = materialize(wanted_words(found, wanted), "shard-words")
    discard(found, wanted)
    gone = materialize(statistics(words, window).groupBy("k1").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("gone")), "removed")
    discard(words)
    return gone


def removed(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(documents with removed words, with a column cut of n_words, n_removed and kept, the words left joined by one space; the other
    documents with it). Columns but doc_id and text are named by place. Documents that lose nothing pass by the join without a shuffle."""
    gone = repeats(documents, window, anchor)
    plain, _ = renamed(documents, "doc_id", "text")
    keyed = plain.withColumns({"k1": id_key(), "k2": text_key()}).withColumn("tag", tag("k2"))
    own = F.expr("transform(filter(gone, x -> x.a >= tag and x.a < tag + 4294967296), x -> struct(x.a - tag as a, x.b - tag as b))")

    @F.arrow_udf("n_words long, n_removed long, kept string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        sizes, left_over, parts, kept, held = [], [], [pa.array([], pa.string())], [], 0
        for t, s in zip(text, spans, strict=True):
            words = t.as_py().encode().split()
            n, at, left = len(words), 0, []
            for x in s.as_py() or ():
                left += words[at : x["a"]]
                at = max(at, x["b"])
            left += words[at:]
            sizes.append(n)
            left_over.append(len(left))
            kept.append(b" ".join(left))
            held += len(kept[-1])
            if held > W.CHUNK_BYTES:
                parts.append(pa.array(kept, pa.binary()).cast(pa.string()))
                kept, held = [], 0
        parts.append(pa.array(kept, pa.binary()).cast(pa.string()))
        n, m = pa.array(sizes, pa.int64()), pa.array(left_over, pa.int64())
        return pa.StructArray.from_arrays([n, pc.subtract(n, m), pa.concat_arrays(parts)], ["n_words", "n_removed", "kept"])

    touched, rest = may_be_in(keyed, gone.select("k1"), "k1")
    touched, rest = touched.join(gone, "k1", "left").withColumn("gone", own), rest.withColumn("gone", F.expr("cast(null as array<struct<a: bigint, b: bigint>>)"))
    return tuple(x.withColumn("cut", cut(F.coalesce(F.col("text"), F.lit("")), F.col("gone"))).select(*plain.columns, "cut") for x in (touched, rest))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with texts cut; where nothing goes, the text stays as it is. n_chars, where there is one, follows the text."""
    touched, rest = removed(documents)
    less = F.col("cut.n_removed") > 0
    cols = []
    for new, (old, kind) in zip(touched.columns, documents.dtypes, strict=False):
        value = F.when(less, F.col("cut.kept")).otherwise(F.col(new)) if old == "text" else F.when(less, F.length("cut.kept")).otherwise(F.col(new)) if old == "n_chars" else F.col(new)
        cols.append(value.cast(kind).alias(new))
    return touched.select(*cols).unionByName(rest.drop("cut")).toDF(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched, rest = removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return touched.unionByName(rest).select("doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS lo FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (h) WHERE doc_id > lo),
a AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
t AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT t.doc_id, string_agg(s, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.p = g.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""
