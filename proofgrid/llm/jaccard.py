"""n-gram Jaccard join as a T-occurrence search (DivideSkip), with the components of its links.

A document with n shingles needs T = ceil(0.75 n) of them in common with a partner, so every partner stands in one of its
n - T + 1 shortest inverted lists. Those lists are joined by Spark and propose, for a query document, the others of the list;
the block of documents proposed to one query is then searched by DivideSkip: the query's inverted lists over the block, the short
ones merged with counts, the L longest set aside, and what reaches the required overlap less L probed for, by binary search, in
those; documents that reach the overlap are its links.

How Spark runs it. Shingle hashes travel packed, a sorted array per batch of documents and slice of the hash range; there are
four slices a shuffle partition, so a slice is as large as a partition is. A slice counts in how many documents each shingle
stands and sends back, to the batches, the ones that two or more have. A document whose other shingles already outnumber n - T
can have no partner and leaves. Documents with equal sets are one. The queries of a list are its pivots: first one, the member
whose shingles are the most common; a list whose members are then not of one component takes 64 more, then 4096, and so on, and
only members of other components are proposed to them. So a group of N near copies costs about N comparisons and not N * N, and a
list ends when all its members are in one component or have been queries. Components are exact; links between documents that
already share a component are not produced.

Hot shingles: occurrences inside a batch are counted before the shuffle, and joins on shingles, pivots or labels have a
written table on either side, so that adaptive execution can split a hot key.

Defined cases: a null or empty text has 0 shingles and no links; fewer words than 5 are one shingle; a null id gets a
null component and takes no part in links; rows with equal id are one node, each with its own n_shingles; repeated rows
give repeated results; of equally common pivots the one with the smallest id is taken; a very long text is cut into shingles in one
piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import LAST_ID, discard, drop_shuffles, id_key, materialize, may_be_in, partitions, renamed

NUM, DEN, SHINGLE = 75, 100, 5
BATCH_SHINGLES, BATCH_TEXTS, HOT = 1_000_000, 60_000, 16
#: A list that stays open takes so many times as many pivots in the next round.
MORE_PIVOTS = 64
#: Cost of merging an entry against that of a probe; it sets how many lists are long.
MERGE_COST = 0.0085
LOW, ALL = np.uint64((1 << 48) - 1), np.uint64(0xFFFF)


def place(s: int) -> np.uint64:
    """The upper bits of the tokens of slice s."""
    return np.uint64((s * 40503 & 0xFFFF) << 48)


def shingles(column: pa.Array, k: int, secret: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, text of each shingle, hash) by chunks, repeats included."""
    kind = W.byte_class(True, False)
    for lo, hi, data, offsets in W.chunks(column):
        w = W.Words(data, offsets, kind)
        h, doc = w.hashes(secret), w.text_of_word()
        g = W.grams(h, k)
        ok = W.within(w.first, k, len(g))
        text, value = [doc[: len(g)][ok]], [g[ok]]
        for m in range(1, k):
            short = np.flatnonzero(w.counts == m)
            if len(short):
                text.append(short)
                value.append(W.grams(h, m)[w.first[short]])
        yield lo, hi, np.concatenate(text), np.concatenate(value)


def packed(df: DataFrame, slices: int, k: int) -> DataFrame:
    """(slice, uid, kind, blob, extra): kind 0 heads a batch (ids and sizes; its hot shingles), kind 1 has its part of a slice."""
    secret = W.draw()

    def close(uid: int, ids: list, text: list, value: list) -> pa.RecordBatch:
        ids, text, value = np.concatenate(ids), np.concatenate(text), np.concatenate(value)
        part = ((value >> np.uint64(16)) % np.uint64(slices)).astype(np.int32)
        key = (value & LOW) << np.uint64(16) | text.astype(np.uint64)
        order = np.argsort(part, kind="stable")
        part, key = part[order], key[order]
        bound = np.searchsorted(part, np.arange(slices + 1))
        rows, size, hot_key, hot_part = [], np.zeros(len(ids), np.int64), [], []
        for s in range(slices):
            own = np.sort(key[bound[s] : bound[s + 1]])
            if not len(own):
                continue
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            size += np.bincount((own & ALL).astype(np.int64), minlength=len(ids))
            token = own >> np.uint64(16)
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(start, len(own)))
            weights = b""
            if (count >= HOT).any():
                hot = np.repeat(count >= HOT, count)
                hot_key.append(own[hot])
                hot_part.append(np.full(hot.sum(), s, np.int32))
                weights = count[count >= HOT].astype(np.int64).tobytes()
                own = np.concatenate([own[~hot], token[start[count >= HOT]] << np.uint64(16) | ALL])
            rows.append((s, uid, 1, own.tobytes(), weights))
        none = np.zeros(0, np.uint64)
        hot = np.concatenate([*hot_key, none]).tobytes() + np.concatenate([*hot_part, np.zeros(0, np.int32)]).tobytes()
        rows.append((uid % slices, uid, 0, ids.tobytes() + size.tobytes(), hot))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "uid", "kind", "blob", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        ids, text, value, docs, count = [], [], [], 0, 0
        for b in batches:
            k1 = b.column("k1").to_numpy(zero_copy_only=False)
            for lo, hi, t, v in shingles(b.column("text"), k, secret):
                for i in range(lo, hi, BATCH_TEXTS):  # very many empty texts
                    j = min(hi, i + BATCH_TEXTS)
                    mine = (t >= i - lo) & (t < j - lo) if hi - lo > BATCH_TEXTS else slice(None)
                    if docs and (docs + j - i > BATCH_TEXTS or count + len(v) > BATCH_SHINGLES):
                        yield close(task << 32 | n, ids, text, value)
                        ids, text, value, docs, count, n = [], [], [], 0, 0, n + 1
                    ids.append(k1[i:j])
                    text.append(t[mine] - (i - lo) + docs)
                    value.append(v[mine])
                    docs += j - i
                    count += len(value[-1])
        if docs:
            yield close(task << 32 | n, ids, text, value)
        W.release()

    return df.mapInArrow(run, "slice int, uid long, kind int, blob binary, extra binary")


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition sorted by key, one group at a time; binary values are views of their batch, not copies."""
    now, rows = None, []
    for b in batches:
        at = b.schema.get_field_index(key)
        columns = [map(pa.BinaryScalar.as_buffer, c) if pa.types.is_binary(c.type) else c.to_pylist() for c in b.columns]
        for row in zip(*columns, strict=True):
            value = row[at]
            if rows and value != now:
                yield now, rows
                rows = []
            now = value
            rows.append(row)
    if rows:
        yield now, rows
    W.release()


def shared_shingles(packs: DataFrame, slices: int) -> DataFrame:
    """For every batch and slice, the shingles that two documents or more have, and in how many (65535: as many or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int32()), ("uid", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("extra", pa.binary())])
        for s, rows in by_group(batches, "slice"):
            out = [(*r[:3], r[3].to_pybytes(), r[4].to_pybytes()) for r in rows if r[2] == 0]
            data = [(r[1], np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.int64)) for r in rows if r[2] == 1]
            if data:
                token = np.concatenate([x[1] for x in data]) >> np.uint64(16)
                weight = np.ones(len(token), np.int64)
                end = np.cumsum([len(x[1]) for x in data])
                for e, (_, _, w) in zip(end, data, strict=True):
                    weight[e - len(w) : e] = w
                order = np.argsort(token, kind="stable")
                token, weight = token[order], weight[order]
                start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                count = np.add.reduceat(weight, start)
                many = count >= 2
                token, count = token[start[many]], np.minimum(count[many], 65535).astype(np.uint16)
                for uid, keys, _ in data:
                    if len(token):
                        at = np.minimum(np.searchsorted(token, keys >> np.uint64(16)), len(token) - 1)
                        hit = token[at] == keys >> np.uint64(16)
                        if hit.any():
                            out.append((s, uid, 1, keys[hit].tobytes(), count[at[hit]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return packs.repartition(partitions(packs.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(run, packs.schema)


def states(returned: DataFrame, slices: int) -> DataFrame:
    """(k1, n, sig, weight, lead, tokens): n shingles; tokens (those shared with others, rarest first) only where partners are possible,
    lead of them in the short lists; sig only where all are shared."""
    schema = pa.schema([("k1", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("weight", pa.float64()), ("lead", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for _, rows in by_group(batches, "uid"):
            head = next(r for r in rows if r[2] == 0)
            ids, size = np.frombuffer(head[3], np.int64).reshape(2, -1)
            hot = np.frombuffer(head[4], np.uint8)
            n_hot = len(hot) // 12
            hot_key, hot_part = hot[: 8 * n_hot].view(np.uint64), hot[8 * n_hot :].view(np.int32)
            tokens, text, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, _, kind, blob, extra in rows:
                if kind == 0:
                    continue
                key, n_in = np.frombuffer(blob, np.uint64), np.frombuffer(extra, np.uint16).astype(np.int64)
                whole = (key & ALL) == ALL
                tokens.append(key[~whole] >> np.uint64(16) | place(s))
                text.append((key[~whole] & ALL).astype(np.int64))
                df.append(n_in[~whole])
                if whole.any():
                    own = hot_key[hot_part == s]
                    at = np.searchsorted(key[whole] >> np.uint64(16), own >> np.uint64(16))
                    tokens.append(own >> np.uint64(16) | place(s))
                    text.append((own & ALL).astype(np.int64))
                    df.append(n_in[whole][at])
            tokens, text, df = np.concatenate(tokens), np.concatenate(text), np.concatenate(df)
            order = np.lexsort((tokens, df, text))
            tokens, text, df = tokens[order], text[order], df[order]
            shared = np.bincount(text, minlength=len(ids))
            first = np.cumsum(shared) - shared
            lead = size - -(-size * NUM // DEN) + 1 - (size - shared)
            active = (lead > 0) & (shared > 0) & (ids != LAST_ID)
            mean = np.bincount(text, weights=df, minlength=len(ids)) / np.maximum(size, 1)
            sig, blobs = [None] * len(ids), [None] * len(ids)
            for i in np.flatnonzero(active):
                own = tokens[first[i] : first[i] + shared[i]]
                blobs[i] = own.tobytes()
                if shared[i] == size[i]:
                    sig[i] = hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(sig, pa.binary()), pa.array(mean), pa.array(np.minimum(lead, shared), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return returned.repartition(partitions(returned.sparkSession), "uid").sortWithinPartitions("uid").mapInArrow(run, "k1 long, n long, sig binary, weight double, lead int, tokens binary")


def short_lists(reps: DataFrame) -> DataFrame:
    """(token, k1, n, at, weight): the inverted lists to merge; at: the token's place among all n, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead = b.column("lead").to_numpy(zero_copy_only=False)
            flat = [np.frombuffer(x.as_buffer(), np.int64)[:n] for x, n in zip(b.column("tokens"), lead, strict=True)]
            row = np.repeat(np.arange(len(lead)), lead)
            size, shared = b.column("n").to_numpy(zero_copy_only=False), pc.binary_length(b.column("tokens")).to_numpy(zero_copy_only=False) // 8
            at = (size - shared)[row] + np.arange(len(row)) - (np.cumsum(lead) - lead)[row]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*flat, np.zeros(0, np.int64)])), *(b.column(c).take(pa.array(row)) for c in ("k1", "n")), pa.array(at), b.column("weight").take(pa.array(row))], ["token", "k1", "n", "at", "weight"])

    return reps.select("k1", "n", "weight", "lead", "tokens").mapInArrow(run, "token long, k1 long, n long, at long, weight double")


def fits(n: str, at: str, m: str, to: str):
    """What can still be in common from these places on reaches the similarity. Where it is so at no common token, it is not so at
    the first one, and the two are no link; it also keeps sizes apart that cannot link."""
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) * (NUM + DEN) >= (F.col(n) + F.col(m)) * NUM


def search(query: np.ndarray, n: int, block: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which documents of a block have the overlap with a query that links them; query: its tokens, sorted; n and sizes: shingles of each."""
    need = -(-NUM * (n + sizes) // (NUM + DEN))
    flat = np.concatenate(block)
    owner = np.repeat(np.arange(len(block)), [len(x) for x in block])
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    entries, length = owner[order], np.bincount(at, minlength=len(query))  # the inverted list of each token, documents in order
    ends = np.cumsum(length)
    t = max(int(need.min()), 1)
    most = min(t - 1, int(t / (MERGE_COST * np.log2(max(length.max(), 2)) + 1)))
    long = np.argsort(-length, kind="stable")[:most]
    short = np.ones(len(query), bool)
    short[long] = False
    count = np.bincount(entries[np.repeat(short, length)], minlength=len(block))
    left = np.flatnonzero(count >= need - most)
    for token in long:
        own = entries[ends[token] - length[token] : ends[token]]
        if len(own) and len(left):
            where = np.minimum(np.searchsorted(own, left), len(own) - 1)
            count[left] += own[where] == left
    return count >= need


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b, and what else they carry) whose sets are similar enough: b is searched in blocks, a being the query."""
    names = pairs.columns
    one = sets.select(F.col("k1").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = sets.select(F.col("k1").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, n_a, n_b = (b.column(c).to_numpy() for c in ("a", "n_a", "n_b"))
            keep = np.zeros(len(a), bool)
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
            for lo, hi in zip(start, np.append(start[1:], len(a)), strict=True):
                query = np.sort(np.frombuffer(b.column("t_a")[int(lo)].as_buffer(), np.uint64))
                keep[lo:hi] = search(query, int(n_a[lo]), [np.frombuffer(b.column("t_b")[i].as_buffer(), np.uint64) for i in range(lo, hi)], n_b[lo:hi])
            yield b.select(names).filter(pa.array(keep))
        W.release()

    return pairs.join(two, "b").join(one, "a").select(*names, "n_a", "n_b", "t_a", "t_b").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def more(edges: DataFrame, found: DataFrame) -> DataFrame:
    out = materialize(edges.union(found), "links")
    discard(edges)
    return out


def links(state: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all links. Reads a written state, and deletes it and each table of its own after its last use."""
    alike = materialize(state.filter("sig is not null").groupBy("sig").agg(F.min("k1").alias("rep")), "equal-sets")
    copies = state.filter("sig is not null").select("k1", "sig").join(alike, "sig").filter("k1 <> rep").select(F.col("rep").alias("a"), F.col("k1").alias("b"))
    edges = materialize(copies, "copies")
    first = alike.select(F.col("rep").alias("k1")).distinct()
    active = state.filter("tokens is not null")
    reps = materialize(active.filter("sig is null").unionByName(active.filter("sig is not null").join(first, "k1", "left_semi")), "sets")
    discard(state, alike)
    lists = materialize(short_lists(reps), "short-lists")
    best = F.max(F.struct("weight", (-F.col("k1")).alias("minus"), "n", "at")).alias("p")
    pivots = materialize(lists.groupBy("token").agg(best, F.count("*").alias("size")).filter("size > 1").select("token", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("n_pivot"), F.col("p.at").alias("at_pivot")), "pivots")
    pairs = lists.join(pivots, "token").filter((F.col("k1") != F.col("pivot")) & fits("n", "at", "n_pivot", "at_pivot")).select(F.col("pivot").alias("a"), F.col("k1").alias("b")).distinct()
    edges = more(edges, linked(pairs, reps))
    labels = components(edges)
    open_ = lists.join(pivots.select("token"), "token", "left_semi")
    members = open_.join(labels, open_["k1"] == labels["node"], "left").select("token", "k1", "n", "at", "weight", F.coalesce("label", "k1").alias("label"))
    used, done, classes, before = [pivots], pivots.select("token", "pivot"), MORE_PIVOTS, [labels, lists]
    while True:
        several = members.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        several = materialize(several.join(done.groupBy("token").agg(F.count("*").alias("asked")), "token").filter("size > asked + 1").select("token"), "open")
        members = materialize(members.join(several, "token"), "open-lists")
        discard(several, *before)
        if members.isEmpty():
            break
        new = members.join(done, (members["token"] == done["token"]) & (members["k1"] == done["pivot"]), "left_anti").groupBy("token", F.pmod(F.xxhash64("k1"), F.lit(classes)))
        new = new.agg(F.max(F.struct("weight", (-F.col("k1")).alias("minus"), "n", "at", "label")).alias("p")).select("token", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("n_pivot"), F.col("p.at").alias("at_pivot"), F.col("p.label").alias("l_pivot"))
        new = materialize(new, "pivots")
        pairs = members.join(new, "token").filter((F.col("label") != F.col("l_pivot")) & fits("n", "at", "n_pivot", "at_pivot")).select(F.col("pivot").alias("a"), F.col("k1").alias("b"), F.col("l_pivot").alias("l_a"), F.col("label").alias("l_b")).distinct()
        found = materialize(linked(pairs, reps), "found")
        if not found.isEmpty():
            edges = more(edges, found.select("a", "b"))
            joined = components(found.select(F.col("l_a").alias("a"), F.col("l_b").alias("b")))
            before = [members, joined]
            own = members.withColumnRenamed("label", "old")
            members = own.join(joined, own["old"] == joined["node"], "left").select("token", "k1", "n", "at", "weight", F.coalesce("label", "old").alias("label"))
        else:
            before = [members]
        discard(found)
        used.append(new)
        done, classes = done.union(new.select("token", "pivot")), classes * MORE_PIVOTS
    discard(reps, members, *used)
    return edges


def groups(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(k1, n_shingles, component): one row for each row of documents; component null where the id is."""
    spark = documents.sparkSession
    slices = 4 * partitions(spark)
    packs = packed(documents.select(id_key(), F.col("text").cast("string").alias("text")), slices, shingle)
    state = materialize(states(shared_shingles(packs, slices), slices), "shingle-sets")
    drop_shuffles(spark)  # those of the packed shingles
    size = materialize(state.select("k1", "n"), "sizes")
    edges = links(state)
    labels = components(edges)
    discard(edges)
    out = size.join(labels, size["k1"] == labels["node"], "left")
    return out.select("k1", F.col("n").alias("n_shingles"), F.when(F.col("k1") != LAST_ID, F.coalesce("label", "k1")).alias("component"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those that link, over any number of links, to a smaller id; all columns stay. Of rows with equal id and
    component one stays; rows without id stay. Rows that have no link and no twin pass by without a shuffle."""
    g = materialize(groups(documents), "groups")
    tells = g.filter("component is not null").groupBy("k1").agg(F.max(F.col("component") != F.col("k1")).alias("worse"), F.count("*").alias("n"))
    tells = materialize(tells.filter("worse or n > 1").select("k1", "worse"), "copies")
    discard(g)
    plain, names = renamed(documents, "doc_id", "text")
    keyed = plain.withColumn("k1", id_key())
    touched, rest = may_be_in(keyed, tells, "k1")
    left = touched.join(tells, "k1", "left")
    once, twins = left.filter("worse is null").drop("worse"), may_be_in(keyed, tells.filter("not worse"), "k1")[0]
    twins = twins.join(tells.filter("not worse").select("k1"), "k1", "left_semi").dropDuplicates(["k1"])
    return rest.unionByName(once).unionByName(twins).select(*plain.columns).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return g.select(F.expr(f"nullif(k1, {LAST_ID}L)").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both_have FROM s p JOIN s q ON p.t = q.t AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
      JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * both_have >= 75 * (na.n + nb.n - both_have)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
