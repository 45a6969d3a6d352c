"""Verdicts out: CSV, JSON and append-only audit tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists", meta: dict[str, str] | None = None) -> None:
    """One CSV part a partition; nested columns as JSON. With meta each part starts with comment lines `# key: value` before its head, so that
    it can be read by itself (readers: comment="#")."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    flat = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in rows.columns])
    if not meta:
        flat.write.mode(mode).csv(path, header=True)
        return
    head = [*(f"# {k}: {v}" for k, v in meta.items()), ",".join(f'"{c}"' if set(c) & set(',"\n') else c for c in flat.columns)]

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        yield from batches

    flat.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in flat.columns])).alias("value")).mapInArrow(started, "value string").write.mode(mode).text(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_run(filings: DataFrame, records: DataFrame, path: str, *, run_mode: str, started_at: str, finished_at: str) -> None:
    """A run's record: one JSON line a filing with its claims, each with the run's head, so that no filing has to wait for another."""
    own = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in records.columns if c not in ("doc_id", "ord")]))).alias("claims"))
    head = {"schema": "reliability.run/v1", "mode": run_mode, "started_at": started_at, "finished_at": finished_at}
    filings.join(own, "doc_id", "left").select(*[F.lit(v).alias(k) for k, v in head.items()], "*").write.json(path)


def append_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not there yet, one for each: an upsert that changes nothing."""
    return rows.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def verdict_counts(verdicts: DataFrame, *keys: str) -> DataFrame:
    """A map of verdict to count for each key."""
    n = verdicts.groupBy(*keys, F.coalesce("status", F.lit("UNKNOWN")).alias("status")).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
