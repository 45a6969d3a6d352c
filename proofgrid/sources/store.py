"""The audit store: its eight tables, and what is read from and added to them, as DataFrames.

Tables are Parquet in a database of the catalog. Spark enforces no keys: new rows pass `sinks.append_new` on their unique columns, and an
update is a rewrite of the table it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

#: Columns of each table, and those that are unique together.
TABLES = {
    "orgs": ("id bigint, name string, created_at timestamp", ["id"]),
    "users": ("id bigint, org_id bigint, email string, name string, created_at timestamp", ["org_id", "email"]),
    "api_keys": ("id bigint, org_id bigint, user_id bigint, key_hash string, key_prefix string, label string, status string, limit_per_minute int, created_at timestamp, rotated_at timestamp, last_used_at timestamp", ["key_hash"]),
    "api_usage": ("id bigint, org_id bigint, api_key_id bigint, method string, path string, created_at timestamp", ["id"]),
    "audits": ("id bigint, org_id bigint, user_id bigint, api_key_id bigint, ticker string, source_label string, score_json string, verdict_counts_json string, result_json string, created_at timestamp", ["id"]),
    "watchlists": ("id bigint, org_id bigint, ticker string, last_seen_accession string, last_checked_at timestamp, created_at timestamp", ["org_id", "ticker"]),
    "webhooks": ("id bigint, org_id bigint, url string, event_type string, secret string, active boolean, created_at timestamp", ["id"]),
    "webhook_deliveries": ("id bigint, org_id bigint, webhook_id bigint, watchlist_id bigint, ticker string, accession string, event_type string, payload_json string, status string, attempts int, next_attempt_at timestamp, last_error string, created_at timestamp, delivered_at timestamp", ["id"]),
}


def create(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (columns, _) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append(rows: DataFrame, table: str) -> None:
    """Add rows whose unique columns are not there yet; the others change nothing."""
    spark, name = rows.sparkSession, table.split(".")[-1]
    have = spark.table(table)
    typed = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have.schema])
    sinks.append_new(typed, have, TABLES[name][1]).select(*typed.columns).write.insertInto(table)


def audit_rows(results: DataFrame, scores: DataFrame, *, org: Column, ticker: Column, label: Column, at: Column) -> DataFrame:
    """A history row of each audited document: score, counts of verdicts and the whole result as JSON. results: doc_id, status, json; conflicts are among
    the results and count once."""
    counts = sinks.verdict_counts(results, "doc_id")
    whole = results.groupBy("doc_id").agg(F.concat(F.lit('{"results": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda r: r["json"]), ", "), F.lit("]}")).alias("result_json"))
    s = scores.select("doc_id", F.to_json(F.struct(*[c for c in sorted(scores.columns) if c != "doc_id"])).alias("score_json"))
    x = s.join(counts, "doc_id").join(whole, "doc_id")
    return x.select("doc_id", org.alias("org_id"), F.upper(ticker).alias("ticker"), label.alias("source_label"), "score_json", F.to_json("counts").alias("verdict_counts_json"), "result_json", at.alias("created_at"))


def latest_audits(audits: DataFrame, org_id: int, most: int = 50) -> DataFrame:
    """An organisation's last audits without their results (the list's feature)."""
    return audits.filter(F.col("org_id") == org_id).drop("result_json").orderBy(F.desc("id")).limit(most)


def audit(audits: DataFrame, org_id: int, audit_id: int) -> DataFrame:
    return audits.filter((F.col("org_id") == org_id) & (F.col("id") == audit_id))


def listed(rows: DataFrame, org_id: int, by: str) -> DataFrame:
    """An organisation's rows in order: watchlists by ticker, webhooks and keys by id."""
    return rows.filter(F.col("org_id") == org_id).orderBy(by)


def seen(watchlists: DataFrame, updates: DataFrame) -> DataFrame:
    """The watchlists with last_seen_accession and last_checked_at of updates (org_id, id, accession, at; the latest of each) where there is one."""
    last = updates.groupBy("org_id", "id").agg(F.max_by(F.struct("accession", "at"), "at").alias("u"))
    x = watchlists.join(last, ["org_id", "id"], "left")
    there = F.col("u").isNotNull()
    return x.withColumns({"last_seen_accession": F.when(there, F.col("u.accession")).otherwise(F.col("last_seen_accession")), "last_checked_at": F.when(there, F.col("u.at")).otherwise(F.col("last_checked_at"))}).select(*watchlists.columns)


def deliveries(events: DataFrame, hooks: DataFrame, at: Column) -> DataFrame:
    """A pending delivery of each event (org_id, watchlist_id, ticker, accession, filing, a map) to each of its organisation's active hooks for filings."""
    active = hooks.filter("active and event_type = 'filing_detected'").select("org_id", F.col("id").alias("webhook_id"))
    payload = F.to_json(F.struct("accession", F.lit("filing_detected").alias("event"), "filing", "ticker"))
    return events.join(active, "org_id").select("org_id", "webhook_id", "watchlist_id", "ticker", "accession", F.lit("filing_detected").alias("event_type"), payload.alias("payload_json"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), at.alias("next_attempt_at"))


def attempted(due: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Due deliveries after an attempt (outcomes: id, error, null where it went through): delivered, or to be tried again after 2 to the power of the
    attempts seconds, an hour at most, or failed at the fifth."""
    x = due.join(outcomes, "id").withColumn("attempts", F.col("attempts") + 1)
    bad = F.col("error").isNotNull()
    wait = F.least(F.lit(3600.0), F.pow(F.lit(2.0), F.col("attempts"))).cast("long")
    return x.select("id", "attempts", F.when(~bad, "delivered").when(F.col("attempts") >= 5, "failed").otherwise("retry").alias("status"), F.when(bad, F.timestamp_seconds(F.unix_timestamp(now) + wait)).alias("next_attempt_at"), F.substring("error", 1, 500).alias("last_error"), F.when(~bad, now).alias("delivered_at"))
