"""Runs of rises and falls over points as rows: no series stands in one row or one task.

Points are sorted by series and time, in ranges. Within a range each point gets the way from the point before and how many steps in that way end at it; what a range
needs from those before is the last point's value, way and run, one row for each range, which the driver chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

PLACE_BITS = 33
WAYS = {1: "up", -1: "down", 0: "flat"}


def sign(new: float, old: float) -> int:
    return (new > old) - (new < old)


def runs(points: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """points with way (up, down or flat from the point before; null at the first of a series) and run (how many steps that way, without another between, end at the point; 0 at
    the first). value is a number; points with a null key, order or value are left out; those that tie in order stand by their value."""
    own = [c for c in points.columns if c not in ("way", "run")]
    x = points.select(*own).filter(" and ".join(f"`{c}` is not null" for c in [*keys, *order, value])).withColumns({"__key": F.to_json(F.struct(*keys)), "__value": F.col(value).cast("double")})
    by = ["__key", *order, "__value"]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = x.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, value, way, run and place of the row before
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("__value").to_numpy()
            k = b.column("__key").dictionary_encode().indices.to_numpy()
            same = np.concatenate([[last is not None and last[0] == b.column("__key")[0].as_py()], k[1:] == k[:-1]])
            before = np.concatenate([[last[1] if last else 0.0], v[:-1]])
            way = np.where(same, np.sign(v - before), 2).astype(np.int64)  # 2: the first of its series here
            i = np.arange(len(v))
            carried = bool(same[0])
            start = np.maximum.accumulate(np.where(~same, i, -1))  # of the series; -1 where it began before this batch
            place = np.where(start >= 0, i - start, i + (last[4] + 1 if carried else 0))
            turn = np.concatenate([[not (carried and way[0] == last[2])], way[1:] != way[:-1]]) | ~same
            at = np.maximum.accumulate(np.where(turn, i, -1))
            run = np.where(at >= 0, i - at + 1, i + 1 + (last[3] if carried else 0))
            run = np.where(way == 2, 0, run)
            last = (b.column("__key")[len(v) - 1].as_py(), v[-1], int(way[-1]), int(run[-1]), int(place[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(way), pa.array(run), pa.array(place)], [*b.schema.names, "__way", "__run", "__place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    t = cut(dealt.mapInArrow(count, f"{schema}, __way long, __run long, __place long"))
    part = F.shiftright("__at", PLACE_BITS)
    end = lambda c: F.max_by(c, "__at").alias(c)
    ends = sorted(t.groupBy(part.alias("part")).agg(F.min_by("__key", "__at").alias("first"), F.min_by("__value", "__at").alias("begin"), *map(end, ("__key", "__value", "__way", "__run", "__place"))).collect(), key=lambda r: r.part)
    rows, before = [], None  # before: key, value, way and run of the last point of the ranges so far
    for r in ends:
        way, run = 2, 0
        if before is not None and before[0] == r["first"]:
            way = sign(r.begin, before[1])
            run = before[3] + 1 if way == before[2] else 1
            rows.append((r.part, r["first"], way, run))
        through = r["__key"] == r["first"] and way != 2
        if through and r["__place"] == 0:
            before = (r["__key"], r["__value"], way, run)
        else:
            joined = through and r["__run"] == r["__place"] and r["__way"] == way
            before = (r["__key"], r["__value"], r["__way"], r["__run"] + (run if joined else 0))
    fixes = F.broadcast(points.sparkSession.createDataFrame(rows, "__part long, __first string, __w long, __r long"))
    x = t.join(fixes, (part == F.col("__part")) & (F.col("__key") == F.col("__first")), "left")
    goes_on, head = F.col("__w").isNotNull(), F.col("__place") == 0
    way = F.when(goes_on & head, F.col("__w")).otherwise(F.col("__way"))
    run = F.when(goes_on & head, F.col("__r")).when(goes_on & (F.col("__run") == F.col("__place")) & (F.col("__way") == F.col("__w")), F.col("__run") + F.col("__r")).otherwise(F.col("__run"))
    names = F.create_map(*[F.lit(y) for kv in WAYS.items() for y in kv])
    return x.select(*own, F.try_element_at(names, way.cast("int")).alias("way"), run.alias("run"))


def trailing(with_runs: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, way, run) at the last point of each series: what a claim of consecutive rises is held against."""
    return with_runs.groupBy(*keys).agg(F.max_by(F.struct("way", "run"), F.struct(*order, value)).alias("x")).select(*keys, "x.way", "x.run")
