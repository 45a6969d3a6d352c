"""Conversation prefix trie by partition refinement.

All conversations are one class at first. A round takes the next turns of those still active, 4 in the first round and twice as many in each further
one, and splits their classes turn by turn: conversations stay together as long as their turns agree. Who is alone in a class is retired: its
remaining turns are a chain of nodes with one child each, which need no further round. The rounds end when nobody is left, so they are about the
logarithm of the longest prefix that two conversations share. Then the trie is folded back: what a node's smallest member gathers below it (leaves,
saved tokens) is summed into every class that this member went through.

A class is the digest of its turns, which names the same class in every task without a join; sizes and smallest members are sums over classes,
combined before they are shuffled. Turns are placed within a conversation by ranges, so none has to fit in one task. Ids that end
at one node are written in blocks of BLOCK ids and digested as a stream.

Defined cases: a null role or text is empty; a null conv_id has no conversation and is left out; a null turn comes first, equal turns stand in the order
of their digests (role and text); repeated rows are turns of their own; a very long text is one turn; an empty table has no node, not
even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import counted_join, numbered
from .shared import materialize, partitions

ROOT, EMPTY = b"", hashlib.sha256(b"").hexdigest()
#: Turns of the first round and the most of a round.
FIRST, MOST = 4, 1 << 16
#: Ids that end at a node are written in blocks of so many.
BLOCK = 4096
#: Rows of a conversation that carry one copy of what is joined to its turns.
STRETCH = 4096


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, words) of every turn: key tells role and text, words is what a trainer would save."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): turns numbered from 0 within their conversation."""
    return numbered(digested(conversations), "conv_id", F.asc_nulls_first("turn"), F.asc("key")).select("conv_id", "pos", "key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, all conv_ids) after each conversation c has taken its first h = crc32(c) % 4 turns from conversation c - c % 20 (fewer where that has fewer, none where
    it is not there) in place of its own."""
    head: Column = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = materialize(turns.select("conv_id").distinct(), "convs")
    wants = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), head.alias("h")).filter("h > 0")
    lent = turns.filter("conv_id % 20 = 0 and pos < 3").select(F.col("conv_id").alias("base"), "pos", "key", "words")
    taken = lent.join(wants, "base").filter("pos < h").select("conv_id", F.lit(0).alias("own"), "pos", "key", "words")
    own = turns.filter(F.col("pos") >= head).select("conv_id", F.lit(1).alias("own"), "pos", "key", "words")
    again = taken.unionByName(own).withColumnRenamed("pos", "old")
    return numbered(again, "conv_id", F.asc("own"), F.asc("old")).select("conv_id", "pos", "key", "words"), convs


def stepped(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, class, words) of each turn of a round. blocks: conv_id, class, depth, steps (key, words in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, depths, classes, words = [], [], [], []
            for c, name, depth, steps in zip(*(b.column(n).to_pylist() for n in ("conv_id", "class", "depth", "steps")), strict=True):
                for s in steps:
                    name, depth = hashlib.sha256(name + s["key"]).digest(), depth + 1
                    conv.append(c)
                    depths.append(depth)
                    classes.append(name)
                    words.append(s["words"])
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depths, pa.int64()), pa.array(classes, pa.binary()), pa.array(words, pa.int64())], ["conv_id", "depth", "class", "words"])

    return blocks.mapInArrow(run, "conv_id long, depth long, class binary, words long")


def refined(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, classes, alone): paths (conv_id, depth, class, words) in classes that conversations share; classes (class, depth, n, rep, words) are those, rep the smallest
    member; alone (conv_id, depth): who is alone, and from which depth on."""
    active = materialize(turns.select("conv_id").distinct().withColumn("class", F.lit(ROOT)), "active")
    done, width, out = 0, FIRST, []
    while not out or not active.isEmpty():
        block = turns.filter((F.col("pos") >= done) & (F.col("pos") < done + width)).join(active, "conv_id")
        steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))), lambda s: F.struct(s["key"].alias("key"), s["words"].alias("words")))
        paths = materialize(stepped(block.groupBy("conv_id", "class").agg(steps.alias("steps")).withColumn("depth", F.lit(done).cast("long"))), "paths")
        classes = materialize(paths.groupBy("class", "depth").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.first("words").alias("words")), "classes")
        alone = materialize(classes.filter("n = 1").groupBy(F.col("rep").alias("conv_id")).agg(F.min("depth").alias("depth")), "alone")
        shared = paths.join(alone.select("conv_id", F.col("depth").alias("from")), "conv_id", "left").filter("from is null or depth < from").drop("from")
        out.append((shared, classes.filter("n > 1"), alone))
        done += width
        active = materialize(paths.filter(F.col("depth") == done).select("conv_id", "class").join(alone, "conv_id", "left_anti"), "active")
        width = min(2 * width, MOST)
    first = out[0]
    for more in out[1:]:
        first = tuple(a.unionByName(b) for a, b in zip(first, more, strict=True))
    return first


def ends_digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of the conv_ids that end at each node (rep, depth, conv_id), in ascending order. Blocks of ids are joined first; a node's blocks
    then pass through one digest as a stream, of which a task holds one block at a time."""
    blocks = ends.groupBy("rep", "depth", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = blocks.repartition(partitions(ends.sparkSession), "rep", "depth").sortWithinPartitions("rep", "depth", "block").select("rep", "depth", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["rep", "depth", "ends_sha256"])
            done.clear()
            return rows

        for b in batches:
            for rep, depth, ids in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if at == (rep, depth):
                    digest.update(b",")
                else:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (rep, depth), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield batch()
        if at is not None:
            done.append((*at, digest.hexdigest()))
            yield batch()

    return dealt.mapInArrow(run, "rep long, depth long, ends_sha256 string")


def with_parents(rows: DataFrame, up: DataFrame, root: int) -> DataFrame:
    """rows (conv_id, depth) with the smallest member of the class one turn before; up has those of shared classes, all others hang on the root."""
    return rows.join(up, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(root)))


def folded(paths: DataFrame, tips: DataFrame) -> DataFrame:
    """(rep, depth, n, n_leaves, saved_tokens) of each shared class: the leaves of the members that stand for one, and what the classes save that its members
    stand for, from its own turn on."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saves = F.when(F.col("conv_id") == F.col("rep"), (F.col("n") - 1) * F.col("words")).otherwise(0)
    each = paths.withColumn("saved", F.sum(saves).over(after)).join(tips.withColumn("tip", F.lit(1)), "conv_id", "left")
    return each.groupBy("rep", "depth").agg(F.count("*").alias("n"), F.count("tip").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def chains(turns: DataFrame, retired: DataFrame) -> DataFrame:
    """The nodes of which one conversation is the only member: retired has conv_id, depth (of the first one), parent, turns. A long conversation's row is copied for
    each STRETCH of its turns, so that its join has no hot key."""
    copies = retired.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("turns") - 1) / STRETCH)))).withColumnRenamed("depth", "from")
    x = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.floor(F.col("pos") / STRETCH).alias("stretch")).join(copies, ["conv_id", "stretch"]).filter("depth >= from")
    last, one, none = F.col("depth") == F.col("turns"), F.lit(1).cast("long"), F.lit(0).cast("long")
    return x.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node: conv_id is its smallest member, and its last turn is that
    conversation's turn at position depth - 1. turns: conv_id, pos (0, 1, ...), key, words, written; convs: conv_id of all conversations, written."""
    shared, classes, alone = refined(turns)
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).first()
    total = classes.agg(F.sum("n")).first()[0] or 0
    paths = materialize(counted_join(shared, classes.select("class", "n", "rep"), "class", "n", total, "conv_id", "depth").select("conv_id", "depth", "words", "n", "rep"), "paths")
    lengths = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("turns")), "lengths")
    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    nodes = materialize(with_parents(paths.filter("conv_id = rep").select("conv_id", "depth"), up, top.rep), "nodes")
    retired = materialize(with_parents(alone, up, top.rep).join(lengths, "conv_id"), "retired")

    child = nodes.select("parent", "depth").unionByName(retired.select("parent", "depth"))
    children = child.groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    inner = nodes.select(F.col("conv_id").alias("rep"), "depth").join(children, ["rep", "depth"], "left_anti")
    tips = materialize(retired.select("conv_id").unionByName(inner.select(F.col("rep").alias("conv_id"))), "tips")
    turnless = convs.join(lengths, "conv_id", "left_anti").select(F.lit(top.rep).cast("long").alias("rep"), F.lit(0).cast("long").alias("depth"), "conv_id")
    ends = ends_digests(paths.join(lengths, "conv_id").filter("depth = turns").select("rep", "depth", "conv_id").unionByName(turnless))

    below = folded(paths, tips).join(nodes.select(F.col("conv_id").alias("rep"), "depth", "parent"), ["rep", "depth"])
    saved = below.filter("depth = 1").agg(F.sum("saved_tokens")).first()[0] or 0  # every shared class is below one of those
    root = paths.sparkSession.createDataFrame([(top.rep, 0, None, top.n, max(tips.count(), 1), saved)] if top.n else [], "rep long, depth long, parent long, n long, n_leaves long, saved_tokens long")
    whole = below.select("rep", "depth", "parent", "n", "n_leaves", "saved_tokens").unionByName(root)
    x = whole.join(children, ["rep", "depth"], "left").join(ends, ["rep", "depth"], "left")
    out = x.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return out.unionByName(chains(turns, retired))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(materialize(turns, "turns"), convs)


SQL = r"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM t),
c AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda d, e: xor(d >> 1, (d & 1) * 3988292384))) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM c),
r AS (SELECT h.conv_id, 0 AS own, pos, key, words FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.pos < h.h
      UNION ALL SELECT h.conv_id, 1, pos, key, words FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos >= h.h),
n AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM r),
p AS (SELECT conv_id, depth, words, md5(string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM n UNION ALL SELECT conv_id, 0, 0, '' FROM c),
g AS (SELECT node, depth, min(conv_id) AS rep, count(*) AS n, any_value(words) AS words FROM p GROUP BY ALL),
u AS (SELECT g.*, q.node AS up FROM g LEFT JOIN p q ON q.conv_id = g.rep AND q.depth = g.depth - 1),
k AS (SELECT up AS node, count(*) AS kids FROM u WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT u.*, v.rep AS parent, coalesce(k.kids, 0) AS kids FROM u LEFT JOIN g v ON v.node = u.up LEFT JOIN k ON k.node = u.node),
e AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) USING (conv_id, depth) GROUP BY 1),
a AS (SELECT p.conv_id, p.node, sum(CASE WHEN f.rep = p.conv_id THEN (f.n - 1) * f.words ELSE 0 END) OVER (PARTITION BY p.conv_id ORDER BY p.depth DESC) AS saved,
             max(CASE WHEN f.kids = 0 AND f.rep = p.conv_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS tip FROM p JOIN f USING (node)),
s AS (SELECT node, sum(saved)::BIGINT AS saved, sum(tip)::BIGINT AS leaves FROM a GROUP BY 1)
SELECT rep AS conv_id, depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN e USING (node)
"""
