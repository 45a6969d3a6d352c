"""Webhook deliveries as a stream: sent, tried again on a ladder of waits, given up at the fifth failure.

`Queue` takes a delivery once by its id, by Spark's own deduplication, and keeps those that wait for their next attempt in a table that a batch replaces when anything is due. A batch's new
deliveries and those that waited long enough are sent in the tasks that read them, with no shuffle and without a step in Python for each delivery but the call of `deliver` on a frame. The
outcomes are written before anything else is made of them: a batch that Spark runs again after a restart sends only what has no outcome of this batch yet; a task that dies between
sending and writing sends again, with the same id and attempt, by which a receiver can tell. A tick a second starts batches where nothing new comes, so waits end to the second.

`Ladder` is the same ladder as a stateful operator, for a stream of one's own that is grouped by delivery: it never sends, but emits what is to be sent now, and takes the outcomes as rows. It costs
several calls from Python to the JVM a delivery and step.

Defined cases: a null id is no delivery and is left out; an id that comes again while it is known changes nothing; an outcome of another attempt than the one awaited is
ignored; a null payload is sent as null; a call of `deliver` that raises is the error of its rows. A delivery is forgotten `keep` after it ended (`Queue`: no sooner than `keep` and all its
waits after it came), so state does not grow for ever.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LONGEST, TRIES, KEEP = 3600, 5, 86400
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "id long, kind string, attempt int, wait long, error string, payload string, at long"
OUTCOMES = "id long, attempt int, error string"
CALLS, WAITING = f"{OUTCOMES}, payload string", "id long, tried int, payload string, due long"


class Ladder(StatefulProcessor):
    """Rows of one delivery: attempt 0 is the delivery itself, others are outcomes, whose error is null where it went through. Gives rows of ROWS: kind `send` with
    the number of the attempt to be made, then `delivered`, `retry` with its wait in units, or `failed`. unit: the milliseconds of a unit of waiting; keep: those after which it is forgotten."""

    def __init__(self, unit: int, keep: int):
        self.unit, self.keep = unit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "attempts int, status string, payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, was = timerValues.getCurrentProcessingTimeInMs(), self.state.get() if self.state.exists() else None
        is_ = was
        for r in rows:
            if is_ is None:
                if r.attempt == 0:
                    is_ = (0, "pending", r.payload)
                    yield self.row(key, "send", 1, now, payload=r.payload)
                continue
            tried, status, payload = is_
            if status not in ("pending", "retry") or r.attempt != tried + 1:
                continue
            if r.error is not None and r.attempt < TRIES:
                wait = min(LONGEST, 2**r.attempt)
                self.handle.registerTimer(now + wait * self.unit)
                is_ = (r.attempt, "retry", payload)
                yield self.row(key, "retry", r.attempt, now, wait=wait, error=r.error[:500])
            else:
                kind = "delivered" if r.error is None else "failed"
                self.handle.registerTimer(now + self.keep)
                is_ = (r.attempt, kind, None)
                yield self.row(key, kind, r.attempt, now, error=r.error and r.error[:500])
        if is_ != was:
            self.state.update(is_)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        tried, status, payload = self.state.get()
        if status == "retry":
            yield self.row(key, "send", tried + 1, timerValues.getCurrentProcessingTimeInMs(), payload=payload)
        else:
            self.state.clear()

    @staticmethod
    def row(key: tuple, kind: str, attempt: int, at: int, *, wait: int | None = None, error: str | None = None, payload: str | None = None) -> Row:
        return Row(id=key[0], kind=kind, attempt=attempt, wait=wait, error=error, payload=payload, at=at)

    def close(self) -> None:
        pass


class Queue:
    """A retry queue that keeps its state, what happened and the outcomes under a path. deliver: takes a frame of id, attempt and payload in a task and gives each row's
    error, null where it went through. unit and keep in seconds."""

    def __init__(self, spark: SparkSession, path: str, deliver: Callable[[pd.DataFrame], Iterable[str | None]], unit: float = 1.0, keep: float = KEEP):
        self.spark, self.path, self.deliver = spark, path.rstrip("/"), deliver
        self.unit, self.keep = max(1, int(unit * 1000)), int(keep * 1000)
        for name, columns in (("outcomes", CALLS), ("log", ROWS)):
            nothing(spark, columns).write.mode("ignore").parquet(f"{self.path}/{name}/batch=none")

    def start(self, deliveries: DataFrame, every: str = "1 second") -> StreamingQuery:
        """Run the queue over a stream of deliveries (id, payload), with a batch as often as `every` says, until it is stopped."""
        known = self.keep + self.unit * sum(min(LONGEST, 2**n) for n in range(1, TRIES))
        new = deliveries.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.col("payload").cast("string").alias("payload"), F.current_timestamp().alias("came"))
        new = new.withWatermark("came", f"{known} milliseconds").dropDuplicatesWithinWatermark(["id"]).select("id", "payload")
        tick = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("payload"))
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)  # ids outside the heap; a query keeps the settings it was started with
        try:
            return new.union(tick).writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/state").trigger(processingTime=every).start()
        finally:
            self.spark.conf.set(PROVIDER, before)

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        spark, here = rows.sparkSession, {name: f"{self.path}/{name}/batch={batch_id}" for name in ("new", "log", "outcomes", "waiting")}
        rows.filter("id is not null").write.mode("overwrite").parquet(here["new"])  # also when there are none: the ids' state is saved as rows are read
        waiting, now = self.waiting(batch_id), millis()
        new = spark.read.schema("id long, payload string").parquet(here["new"]).select("id", F.lit(0).alias("tried"), "payload")
        due = new.unionByName(waiting.filter(F.col("due") <= now).drop("due"))
        if due.isEmpty():
            return
        due = due.select("id", (F.col("tried") + 1).alias("attempt"), "payload")
        step = lambda kind, wait=None, error=None, at=now: [F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.col("attempt"), F.lit(wait).cast("long").alias("wait"), F.lit(error).cast("string").alias("error"), F.lit(at).cast("long").alias("at")]
        due.select("id", *step("send")).write.mode("overwrite").parquet(f"{here['log']}/step=send")
        nothing(spark, CALLS).write.mode("append").parquet(here["outcomes"])
        sent = spark.read.schema(OUTCOMES).parquet(here["outcomes"]).select("id", "attempt")
        left = due if sent.isEmpty() else due.join(sent, ["id", "attempt"], "left_anti")
        left.mapInPandas(sender(self.deliver), CALLS).write.mode("append").parquet(here["outcomes"])
        done, at = spark.read.schema(CALLS).parquet(here["outcomes"]), millis()
        again, wait = F.col("error").isNotNull() & (F.col("attempt") < TRIES), F.least(F.lit(LONGEST), F.pow(F.lit(2), "attempt")).cast("long")
        kind = F.when(F.col("error").isNull(), "delivered").when(again, "retry").otherwise("failed")
        done.select("id", *step(kind, F.when(again, wait), F.left("error", F.lit(500)), at)).write.mode("overwrite").parquet(f"{here['log']}/step=done")
        back = done.filter(again).select("id", F.col("attempt").alias("tried"), "payload", (wait * self.unit + at).alias("due"))
        waiting.filter(F.col("due") > now).unionByName(back).write.mode("overwrite").parquet(here["waiting"])

    def waiting(self, before: int) -> DataFrame:
        """WAITING, as the last batch before the given one that changed it left it."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/waiting/batch=*/_SUCCESS")
        there = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path) or []
        last = max((n for n in (int(x.getPath().getParent().getName().removeprefix("batch=")) for x in there) if n < before), default=None)
        return nothing(self.spark, WAITING) if last is None else self.spark.read.schema(WAITING).parquet(f"{self.path}/waiting/batch={last}")

    def history(self) -> DataFrame:
        """(id, kind, attempt, wait, error, at) of every step so far; empty before the first batch."""
        return self.spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{self.path}/log").drop("payload").withColumn("at", F.timestamp_millis("at"))

    def ended(self) -> int:
        """How many deliveries went through or failed so far."""
        return self.history().filter("kind in ('delivered', 'failed')").select("id").distinct().count()

    def outcomes(self) -> DataFrame:
        """(id, attempt, error) of every call of deliver that has come back."""
        return self.spark.read.schema(OUTCOMES).option("recursiveFileLookup", "true").parquet(f"{self.path}/outcomes")

    def deliveries(self) -> DataFrame:
        """(id, status, attempts, waited, last_error) of every delivery so far: pending before its first outcome; waited in units, the wait it is in included."""
        h = self.history().filter("kind <> 'send' or attempt = 1")
        done = F.col("kind") != "send"
        last = F.max(F.when(done, F.struct("attempt", "kind", "error")))
        x = h.groupBy("id").agg(last.alias("x"), F.coalesce(F.sum("wait"), F.lit(0)).alias("waited"))
        return x.select("id", F.coalesce("x.kind", F.lit("pending")).alias("status"), F.coalesce("x.attempt", F.lit(0)).alias("attempts"), "waited", F.col("x.error").alias("last_error"))


def millis() -> int:
    return int(time.time() * 1000)


def nothing(spark: SparkSession, columns: str) -> DataFrame:
    """No rows, without a task in Python."""
    return spark.range(0).select(*[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in columns.split(", ")])


def sender(deliver: Callable[[pd.DataFrame], Iterable[str | None]]):
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            try:
                error = list(deliver(f))
            except Exception as e:  # the receiver's fault, not the stream's
                error = [f"{type(e).__name__}: {e}"] * len(f)
            yield pd.DataFrame({"id": f["id"].to_numpy(), "attempt": f["attempt"].to_numpy(), "error": pd.Series(error, dtype=object), "payload": f["payload"].to_numpy()})

    return send
