"""Global ranks, places within a key and joins on hot keys, without a task or a broadcast that grows with one key.

Rows are dealt by ranges of their order, sorted there and written with their place in the range; what the driver sees is a few numbers
of each range. The ranges are as many as the shuffle partitions, so those numbers stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, partitions

#: A key with more than one in SHARE of all rows is hot; so fewer than SHARE keys are.
SHARE = 4096
PLACE_BITS = 33


def small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank 1, 2, 3, ... in the order given; rows that tie in all of it may stand either way. Columns of order are of bounded size, as Spark
    samples them for the ranges."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    t = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", PLACE_BITS)
    counts = sorted(t.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    bases = small(df, [(p, b) for (p, _), b in zip(counts, before, strict=False)], "__part long, __base long")
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return t.join(bases, part == F.col("__part")).withColumn("rank", F.col("__base") + place + 1).drop("__at", "__part", "__base")


def numbered(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """df with pos 0, 1, 2, ... of each row among those of its key (long, not null) in the order given. A key may lie in many ranges: where one goes on
    from the range before, the driver adds what stands there, from each range's first and last key."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("__at", F.monotonically_increasing_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy()
            new = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            pos = np.arange(len(k)) - first
            if last == k[0]:
                pos[first == 0] += seen
            last, seen = k[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos)], [*b.schema.names, "pos"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    t = materialize(dealt.mapInArrow(count, f"{schema}, pos long"), "numbered")
    part = F.shiftright("__at", PLACE_BITS)
    ends = t.groupBy(part.alias("part")).agg(F.min_by(key, "__at"), F.max_by(key, "__at"), F.max_by("pos", "__at") + 1)
    rows, before, run = [], None, 0
    for p, first, last, n in sorted(ends.collect()):
        carried = run if first == before else 0
        rows.append((p, first, carried))
        before, run = last, n + (carried if first == last else 0)
    bases = small(df, rows, "__part long, __first long, __carried long")
    more = F.when(F.col(key) == F.col("__first"), F.col("__carried")).otherwise(0)
    return t.join(bases, part == F.col("__part")).withColumn("pos", F.col("pos") + more).drop("__at", "__part", "__first", "__carried")


def counted_join(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, *unique: str) -> DataFrame:
    """rows joined with values on key (a digest of 32 bytes, one row each in values). count: how many of all the total rows have the key. Hot keys are fewer than SHARE
    and are broadcast; of the others none has more than a SHARE-th of the rows in one task. unique: columns of rows that spread those found already."""
    names = [n for n in values.columns if n != key]
    hot = F.col(count) > total / SHARE
    few = F.broadcast(values.filter(hot).select(F.col(key).alias("__key"), F.struct(*names).alias("__hot")))
    rest = values.filter(~hot).select(F.col(key).alias("__rest"), F.struct(*names).alias("__cold"))
    seen = rows.join(few, F.col(key) == F.col("__key"), "left")
    at = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.unhex(F.hex(F.xxhash64(*unique))))
    both = seen.withColumn("__at", at).join(rest, F.col("__at") == F.col("__rest"), "left")
    found = F.coalesce("__hot", "__cold")
    return both.filter(found.isNotNull()).select(*rows.columns, *[found[n].alias(n) for n in names])


