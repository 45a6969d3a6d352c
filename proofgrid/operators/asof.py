"""As-of joins: what was known of a key at a time, as the last of its rows up to then.

Both sides are sorted together by key and time, in ranges, so that a key with a third of all rows lies in many ranges and no window holds it. Within a range
the last row is carried forward; what a range needs from those before is one row for each range, the last one that was known at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

PLACE_BITS = 33


def as_of(asked: DataFrame, known: DataFrame, keys: list[str], at: str) -> DataFrame:
    """asked with the other columns of known, from the row of the same keys with the largest `at` not after its own (null where there is none); of rows of known with
    one key and time the one that sorts last by its other columns. Null keys or times of asked find nothing, those of known are not found. Both have keys and at, whose
    types are the same; other columns have names of their own."""
    values = [c for c in known.columns if c not in keys and c != at]
    own = [c for c in asked.columns if c not in keys and c != at]
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__key")
    whole = known.filter(" and ".join(f"`{c}` is not null" for c in [*keys, at]))
    right = whole.groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("__value"))
    kind = right.schema["__value"].dataType
    left = asked.select(key, *keys, at, F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__value"), F.struct(*own).alias("__own") if own else F.lit(None).alias("__own"))
    right = right.select(key, *keys, at, F.lit(0).alias("__side"), "__value", F.lit(None).cast(left.schema["__own"].dataType).alias("__own"))
    order = ("__key", F.asc_nulls_first(at), "__side")
    both = left.unionByName(right).withColumn("__row", F.monotonically_increasing_id())  # spreads the equal rows of a hot key and time over ranges
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(n, *order, "__row").sortWithinPartitions(*order, "__row").drop("__row").withColumn("__at", F.monotonically_increasing_id())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row of known, of the key that stands last
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if last is None else [last, b])
            k = t.column("__key").combine_chunks().dictionary_encode().indices.to_numpy()
            here = t.column("__side").to_numpy() == 0
            new = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            latest = np.maximum.accumulate(np.where(here, np.arange(len(k)), -1))
            found = np.where(latest >= first, latest, -1)
            value = t.column("__value").combine_chunks().take(pa.array(found, mask=found < 0))
            out = t.set_column(t.schema.get_field_index("__value"), "__value", value).slice(0 if last is None else 1)
            yield from out.combine_chunks().to_batches()
            last = t.slice(int(found[-1]), 1).combine_chunks().to_batches()[0] if found[-1] >= 0 else None

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    t = cut(dealt.mapInArrow(carry, schema))
    part = F.shiftright("__at", PLACE_BITS)
    ends = sorted(t.groupBy(part.alias("part")).agg(F.min_by("__key", "__at").alias("first"), F.max_by("__key", "__at").alias("key"), F.max_by("__value", "__at").alias("value")).collect(), key=lambda r: r.part)
    rows, before, value = [], None, None  # what was known at the end of the ranges before, of the key that goes on
    for r in ends:
        rows.append((r.part, r.first, value if r.first == before else None))
        if r.key != before or r.value is not None:
            before, value = r.key, r.value
    carried = asked.sparkSession.createDataFrame(rows, f"__part long, __first string, __before {kind.simpleString()}")
    x = t.filter("__side = 1").join(F.broadcast(carried), (part == F.col("__part")) & (F.col("__key") == F.col("__first")), "left")
    found = F.when(F.col(at).isNotNull(), F.coalesce("__value", "__before"))
    missing = F.lit(False)
    for c in keys:
        missing = missing | F.col(c).isNull()
    return x.withColumn("__found", F.when(~missing, found)).select(*keys, at, *[F.col(f"__own.`{c}`").alias(c) for c in own], *[F.col(f"__found.`{c}`").alias(c) for c in values])
