"""Streams of filings: the batch reference has none; verification itself is the same stateless projection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each accession once; state older than the watermark goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["accession"])


def counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Filings by form in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "form").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "form", "n")


def changes(events: DataFrame) -> DataFrame:
    """(entity, accession, ts) each time an entity's latest filing changes; the state is one accession an entity."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, "")
        rows = []
        for f in frames:
            for r in f.sort_values(["ts", "accession"]).itertuples():
                if last is None or (r.ts.value, r.accession) > (last, seen):
                    last, seen = r.ts.value, r.accession
                    rows.append((key[0], r.accession, r.ts))
        state.update((last, seen))
        yield pd.DataFrame(rows, columns=["entity", "accession", "ts"])

    return events.groupBy("entity").applyInPandasWithState(step, "entity string, accession string, ts timestamp", "last long, seen string", "append", GroupStateTimeout.NoTimeout)
