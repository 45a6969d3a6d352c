"""What depends on what, over any number of steps, as bits: how many claims each claim carries, cycles, and the nearest failing root.

A document's claims are numbered, and who depends on whom is a square of bits, cut into blocks of 64 by 64, of which only those that hold a bit are rows. With E
the claims that are exactly k steps away, E times E is those 2 k steps away, so a chain of n claims takes about log2(n) rounds, and a row stands for
up to 4096 pairs. A document of up to 64 claims is one block, and takes all its rounds in one pass without a join; of larger ones, blocks meet in equi-joins on
(document, block), so no task holds a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, FAR = 64, 2**62
ONE = np.uint64(1)
PLACES = np.arange(BLOCK, dtype=np.uint64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of squares of bits: row r of the result is the union of the rows of b whose bits row r of a has."""
    out = np.zeros_like(a)
    for c in range(a.shape[1]):
        out |= (np.uint64(0) - (a >> np.uint64(c) & ONE)) & b[:, c : c + 1]
    return out


def nearer(a: np.ndarray, dist: np.ndarray, root: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest (dist + step, root) among the columns whose bits each row of a has; FAR where there is none."""
    d, o = np.full(a.shape, FAR, np.int64), np.full(a.shape, FAR, np.int64)
    for c in range(a.shape[1]):
        has = (a >> np.uint64(c) & ONE).astype(bool)
        if not has.any():
            continue
        there = np.where(has & (dist[:, c : c + 1] < FAR), dist[:, c : c + 1] + step, FAR)
        better = (there < d) | ((there == d) & (there < FAR) & (root[:, c : c + 1] < o))
        d, o = np.where(better, there, d), np.where(better, root[:, c : c + 1], o)
    return d, o


def closer(d: np.ndarray, o: np.ndarray, d2: np.ndarray, o2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    better = (d2 < d) | ((d2 == d) & (o2 < o))
    return np.where(better, d2, d), np.where(better, o2, o)


def squares(column: pa.ListArray) -> np.ndarray:
    """Rows of 64 words from lists of (r, word)."""
    out = np.zeros((len(column), BLOCK), np.uint64)
    flat = column.flatten()
    if len(flat):
        owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        out[owner, flat.field("r").to_numpy()] = flat.field("word").to_numpy().view(np.uint64)
    return out


def labels(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(dist, root) of 64 places from lists of (r, dist, root)."""
    d, o = (np.full((len(column), BLOCK), FAR, np.int64) for _ in range(2))
    if len(flat := column.flatten()):
        owner = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        d[owner, flat.field("r").to_numpy()] = flat.field("dist").to_numpy()
        o[owner, flat.field("r").to_numpy()] = flat.field("root").to_numpy()
    return d, o


def columns_of(bits: np.ndarray) -> np.ndarray:
    """How many rows have each column's bit."""
    return np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").reshape(len(bits), -1, BLOCK).sum(axis=1, dtype=np.int64)


def used(e: np.ndarray) -> int:
    """How many numbers the squares go up to, of both rows and columns."""
    rows = np.flatnonzero(e.any(axis=0))
    return max(int(np.bitwise_or.reduce(e, axis=None)).bit_length(), int(rows[-1]) + 1 if len(rows) else 0, 1)


def numbering(edges: DataFrame, *order: str, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, node, idx, big): the nodes of edges, or those given, numbered from 0 in a document; big where it has more than a block of them."""
    if nodes is None:
        nodes = edges.select("doc_id", F.col("src").alias("node")).union(edges.select("doc_id", F.col("dst").alias("node"))).distinct()
    own = Window.partitionBy("doc_id").orderBy(*(order or ("node",)))
    n = nodes.groupBy("doc_id").agg((F.count("*") > BLOCK).alias("big"))
    return nodes.withColumn("idx", (F.row_number().over(own) - 1).cast("long")).join(n, "doc_id")


def gathered(words: DataFrame) -> DataFrame:
    """(doc_id, i, j, rows) of words (doc_id, i, j, r, word): one row a block."""
    one = words.groupBy("doc_id", "i", "j", "r").agg(F.expr("bit_or(word)").alias("word"))
    return one.groupBy("doc_id", "i", "j").agg(F.collect_list(F.struct("r", "word")).alias("rows"))


def upstream(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, big, i, j, rows): the blocks of what each claim directly depends on."""
    src = numbers.select("doc_id", F.col("node").alias("src"), F.col("idx").alias("s"), "big")
    dst = numbers.select("doc_id", F.col("node").alias("dst"), F.col("idx").alias("d"))
    e = edges.select("doc_id", "src", "dst").join(src, ["doc_id", "src"]).join(dst, ["doc_id", "dst"])
    words = e.select("doc_id", "big", F.shiftright("s", 6).alias("i"), F.shiftright("d", 6).alias("j"), (F.col("s") % BLOCK).cast("int").alias("r"), F.expr("shiftleft(1L, cast(d % 64 as int))").alias("word"))
    one = words.groupBy("doc_id", "big", "i", "j", "r").agg(F.expr("bit_or(word)").alias("word"))
    return one.groupBy("doc_id", "big", "i", "j").agg(F.collect_list(F.struct("r", "word")).alias("rows"))


def typed(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def dealt(df: DataFrame) -> DataFrame:
    """Rows of few bytes that much work is made of, by document over all shuffle partitions: Spark joins others by their bytes, to one task of bits at most sizes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


OUT = "idx long, n long, cyclic boolean, dist long, root_ord long"


def within_blocks(blocks: DataFrame, at: DataFrame) -> DataFrame:
    """(doc_id, idx, n, cyclic, dist, root_ord) of documents that are one block each; at: (doc_id, start) lists of (r, dist, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            e = squares(b.column("rows"))
            m = used(e)  # most documents have few claims: only so many rows and columns are looked at
            e = np.ascontiguousarray(e[:, :m])
            d, o = (np.ascontiguousarray(x[:, :m]) for x in labels(b.column("start")))
            all_, k, sources = np.zeros_like(e), 1, (d < FAR).any()
            while e.any() and k <= m:
                if sources:
                    d, o = closer(d, o, *nearer(e, d, o, k))
                all_ |= e | times(e, all_)
                e, k = times(e, e), 2 * k
            cyclic = (all_ >> PLACES[None, :m] & ONE).astype(bool)
            n = columns_of(all_)[:, :m] - cyclic
            some = np.flatnonzero(((n > 0) | cyclic | (d < FAR)).ravel())
            row, idx = some // m, some % m
            dist, root = d.ravel()[some], o.ravel()[some]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(idx), pa.array(n.ravel()[some]), pa.array(cyclic.ravel()[some]), pa.array(dist, mask=dist >= FAR), pa.array(root, mask=dist >= FAR)], ["doc_id", "idx", "n", "cyclic", "dist", "root_ord"])

    return dealt(blocks.select("doc_id", "rows")).join(at, "doc_id", "left").mapInArrow(run, f"doc_id {typed(blocks)}, {OUT}")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, i, j, r, word): the words of the product of two sets of blocks, some of them parts that are still to be united."""
    pairs = a.select("doc_id", "i", F.col("j").alias("m"), "rows").join(b.select("doc_id", F.col("i").alias("m"), "j", F.col("rows").alias("others")), ["doc_id", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                p = times(squares(x.column("rows")), squares(x.column("others")))
                row, r = np.nonzero(p)
                yield pa.RecordBatch.from_arrays([*(x.column(c).take(pa.array(row)) for c in ("doc_id", "i", "j")), pa.array(r.astype(np.int32)), pa.array(p[row, r].view(np.int64))], ["doc_id", "i", "j", "r", "word"])

    return pairs.select("doc_id", "i", "j", "rows", "others").mapInArrow(run, f"doc_id {typed(a)}, i long, j long, r int, word long")


def words_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "i", "j", F.explode("rows").alias("x")).select("doc_id", "i", "j", "x.r", "x.word")


def label_blocks(start: DataFrame) -> DataFrame:
    """(doc_id, j, start) of (doc_id, idx, dist, root)."""
    one = start.groupBy("doc_id", "idx").agg(F.min(F.struct("dist", "root")).alias("x"))
    return one.groupBy("doc_id", F.shiftright("idx", 6).alias("j")).agg(F.collect_list(F.struct((F.col("idx") % BLOCK).cast("int").alias("r"), "x.dist", "x.root")).alias("start"))


def over_blocks(blocks: DataFrame, start: DataFrame, cut) -> DataFrame:
    """The same as within_blocks of documents with many blocks; start: (doc_id, idx, dist, root) of the roots."""

    def step(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d, o = nearer(squares(b.column("rows")), *labels(b.column("start")), k)
                    row, r = np.nonzero(d < FAR)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(b.column("i").to_numpy()[row] * BLOCK + r), pa.array(d[row, r]), pa.array(o[row, r])], ["doc_id", "idx", "dist", "root"])

        return run

    kind = typed(blocks)
    e = blocks.select("doc_id", "i", "j", "rows")
    all_, near, k = e, start.select("doc_id", "idx", "dist", "root"), 1
    while True:
        reached = e.join(label_blocks(near), ["doc_id", "j"]).select("doc_id", "i", "rows", "start").mapInArrow(step(k), f"doc_id {kind}, idx long, dist long, root long")
        near = cut(near.unionByName(reached).groupBy("doc_id", "idx").agg(F.min(F.struct("dist", "root")).alias("x")).select("doc_id", "idx", "x.dist", "x.root"))
        if k > 1:
            all_ = cut(gathered(words_of(all_).unionByName(words_of(e)).unionByName(product(e, all_))))
        e, k = cut(gathered(product(e, e))), 2 * k
        most = e.agg(F.max(F.greatest("i", "j"))).first()[0]
        if most is None or k > BLOCK * (most + 1):
            break

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits, i, j = squares(b.column("rows")), b.column("i").to_numpy(), b.column("j").to_numpy()
                cyclic = (bits >> PLACES[None, :] & ONE).astype(bool) & (i == j)[:, None]
                n = columns_of(bits) - cyclic
                row, c = np.nonzero((n > 0) | cyclic)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(j[row] * BLOCK + c), pa.array(n[row, c]), pa.array(cyclic[row, c])], ["doc_id", "idx", "n", "cyclic"])

    own = all_.mapInArrow(counts, f"doc_id {kind}, idx long, n long, cyclic boolean").groupBy("doc_id", "idx").agg(F.sum("n").alias("n"), F.max("cyclic").alias("cyclic"))
    both = own.join(near, ["doc_id", "idx"], "full")
    return both.select("doc_id", "idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "dist", F.col("root").alias("root_ord"))


def reach(edges: DataFrame, sources: DataFrame | None, cut) -> DataFrame:
    """(doc_id, node, n, cyclic, dist, root_ord) of nodes that others depend on or that depend on a source: n others depend on the node; cyclic: it depends on itself; the
    nearest source, of equals the first, and how far it is (0 for a source itself, null without one). edges: doc_id, src, dst; sources: doc_id, node, root_ord;
    cut writes a table and reads it back."""
    edges = edges.filter("doc_id is not null and src is not null and dst is not null")
    numbers = cut(numbering(edges))
    blocks = cut(upstream(edges, numbers))
    own = numbers.select("doc_id", "node", "idx", "big")
    if sources is None:
        start = own.select("doc_id", "idx", "big", F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("root")).filter("false")
    else:
        start = sources.groupBy("doc_id", "node").agg(F.min("root_ord").cast("long").alias("root")).join(own, ["doc_id", "node"]).select("doc_id", "idx", "big", F.lit(0).cast("long").alias("dist"), "root")
    lists = start.filter("not big").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("r"), "dist", "root")).alias("start"))
    out = within_blocks(blocks.filter("not big"), lists)
    large = blocks.filter("big")
    if not large.isEmpty():
        out = out.unionByName(over_blocks(large, cut(start.filter("big").drop("big")), cut))
    return out.join(own, ["doc_id", "idx"]).select("doc_id", "node", "n", "cyclic", "dist", "root_ord")


def allowed(level: int, kept: np.ndarray, dist: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which numbers a claim would take as its cause, were they a root at this distance: any that is nearer than its own nearest root, or as near and not later."""
    upto = np.where(root >= BLOCK, np.uint64(2**64 - 1), (ONE << np.minimum(root + 1, BLOCK - 1).astype(np.uint64)) - ONE)
    upto = np.where(root == BLOCK - 1, np.uint64(2**64 - 1), np.where(root < 0, np.uint64(0), upto))
    return np.where(~kept | (dist < level), np.uint64(0), np.where(dist > level, np.uint64(2**64 - 1), upto))


def relabelled(edges: DataFrame, claims: DataFrame, cut) -> DataFrame:
    """(doc_id, node, n): how many claims would take the node as their cause, if it alone failed besides those that fail already. claims: doc_id, node, ord, failing. Claims
    are numbered in the order of ord, and the roots of each distance are bits, from the direct ones on; a document that is one block takes one pass."""
    edges = edges.filter("doc_id is not null and src is not null and dst is not null")
    known = claims.groupBy("doc_id", "node").agg(F.min("ord").alias("ord"), F.max("failing").alias("failing"))
    nodes = edges.select("doc_id", F.col("src").alias("node")).union(edges.select("doc_id", F.col("dst").alias("node"))).distinct()
    numbers = cut(numbering(edges, "last", "ord", "node", nodes=nodes.join(known, ["doc_id", "node"], "left").withColumn("last", F.col("ord").isNull())))
    blocks = cut(upstream(edges, numbers))
    state = numbers.select("doc_id", "idx", "big", F.coalesce("failing", F.lit(False)).alias("failing"), F.col("failing").isNotNull().alias("there"))
    lists = state.filter("not big").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("r"), F.when(F.col("failing"), 0).otherwise(F.lit(FAR)).cast("long").alias("dist"), F.when(F.col("failing"), F.col("idx")).otherwise(F.lit(FAR)).cast("long").alias("root"))).alias("start"), F.collect_list(F.struct(F.col("idx").cast("int").alias("r"), F.when(F.col("there") & ~F.col("failing"), F.lit(1)).otherwise(0).cast("long").alias("word"))).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one = squares(b.column("rows"))
            d, o = labels(b.column("start"))
            kept = squares(b.column("kept")) == ONE
            e, k = one, 1
            while e.any() and k <= BLOCK:
                d, o = closer(d, o, *nearer(e, d, o, k))
                e, k = times(e, e), 2 * k
            n, front, seen, level = np.zeros(one.shape, np.int64), one, np.zeros_like(one), 1
            while front.any():
                n += columns_of(front & allowed(level, kept, d, o) & ~(ONE << PLACES)[None, :])
                seen |= front
                front, level = times(one, front) & ~seen, level + 1
            row, c = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(c), pa.array(n[row, c])], ["doc_id", "idx", "n"])

    kind = typed(blocks)
    out = dealt(blocks.filter("not big").select("doc_id", "rows")).join(lists, "doc_id").mapInArrow(run, f"doc_id {kind}, idx long, n long")
    large = blocks.filter("big").drop("big")
    if not large.isEmpty():
        out = out.unionByName(levels(large, state.filter("big"), cut))
    return out.join(numbers.select("doc_id", "node", "idx"), ["doc_id", "idx"]).select("doc_id", "node", "n")


def levels(blocks: DataFrame, state: DataFrame, cut) -> DataFrame:
    """(doc_id, idx, n) of relabelled() over documents with many blocks, a level of distance a round."""
    sources = state.filter("failing").select("doc_id", "idx", F.lit(0).cast("long").alias("dist"), F.col("idx").alias("root"))
    near = over_blocks(blocks, sources, cut).select("doc_id", "idx", F.col("dist").alias("other"), F.col("root_ord").alias("cause"))
    own = cut(state.filter("there and not failing").select("doc_id", "idx").join(near, ["doc_id", "idx"], "left"))
    one = blocks.select("doc_id", "i", "j", "rows")
    front, seen, out, level = one, None, None, 1
    while True:
        w = words_of(front).withColumn("idx", F.col("i") * BLOCK + F.col("r")).join(own, ["doc_id", "idx"])
        full, nothing, first = F.lit(-1).cast("long"), F.lit(0).cast("long"), F.col("cause") - F.col("j") * BLOCK
        upto = F.when(first >= BLOCK - 1, full).when(first < 0, nothing).otherwise(F.expr("~shiftleft(-1L, cast(cause - j * 64 as int) + 1)"))
        takes = F.when(F.col("other").isNull() | (F.col("other") > level), full).when(F.col("other") < level, nothing).otherwise(upto)
        itself = F.when(F.col("i") == F.col("j"), F.expr("~shiftleft(1L, r)")).otherwise(full)
        bits = w.select("doc_id", "j", F.col("word").bitwiseAND(takes).bitwiseAND(itself).alias("word")).filter("word <> 0")
        hit = cut(bits.select("doc_id", "j", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda c: F.call_function("getbit", F.col("word"), c) == 1)).alias("c")).groupBy("doc_id", (F.col("j") * BLOCK + F.col("c")).alias("idx")).agg(F.count("*").alias("n")))
        out = hit if out is None else out.unionByName(hit)
        seen = words_of(front) if seen is None else seen.unionByName(words_of(front))
        past = cut(seen.groupBy("doc_id", "i", "j", "r").agg(F.expr("bit_or(word)").alias("past")))
        seen = past.withColumnRenamed("past", "word")
        new = words_of(gathered(product(one, front))).join(past, ["doc_id", "i", "j", "r"], "left")
        fresh = new.withColumn("word", F.col("word").bitwiseAND(F.coalesce(F.expr("~past"), full))).filter("word <> 0")
        front, level = cut(gathered(fresh.select("doc_id", "i", "j", "r", "word"))), level + 1
        if front.isEmpty():
            return out.groupBy("doc_id", "idx").agg(F.sum("n").alias("n"))
