"""Tables that are updated in place: copy-on-write Parquet in hash buckets of the unique columns.

A change reads and rewrites only the buckets that its keys fall into. New files are staged beside the table first, so a failing job has changed nothing; they go live
when the buckets are swapped by Spark's dynamic partition overwrite. One writer at a time: a writer first creates a lock file, which the file system grants to one of
two; the other fails with `Busy` and can try again on what is then there. So unique columns hold, also after two appends at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, BUCKETS = "bucket", 64


class Busy(RuntimeError):
    """Another writer changes the table."""


class Table:
    """A table at a path. keys: the columns that are unique together; buckets: in how many folders its rows are kept, fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> Table:
        """Write the table; rows that share their keys are an error."""
        if rows.groupBy(*self.keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{self.path}: rows share {self.keys}")
        self._dealt(rows).write.partitionBy(BUCKET).mode("errorifexists").parquet(f"{self.path}/data")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").drop(BUCKET)

    def update(self, changes: DataFrame) -> int:
        """Set the columns of changes, which has the keys, one row each, in the rows that have these keys; other keys change nothing. Gives the number of buckets rewritten."""
        names = [c for c in changes.columns if c not in self.keys]
        new = changes.select(*self.keys, F.struct(*names).alias("__new"))
        if new.groupBy(*self.keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{self.path}: changes share {self.keys}")

        def merged(old: DataFrame) -> DataFrame:
            hit = F.col("__new").isNotNull()
            x = old.join(new, self.keys, "left")
            return x.select(*[F.when(hit, F.col(f"__new.`{f.name}`")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in names else F.col(f.name) for f in old.schema])

        return self._rewrite(changes, merged)

    def append(self, rows: DataFrame) -> int:
        """Add the rows whose keys are not there yet, one of each; the others change nothing. Gives the number of buckets rewritten."""

        def merged(old: DataFrame) -> DataFrame:
            typed = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])
            return old.unionByName(typed.dropDuplicates(self.keys).join(old.select(*self.keys), self.keys, "left_anti").select(*old.columns))

        return self._rewrite(rows, merged)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET))

    def _rewrite(self, changes: DataFrame, merged) -> int:
        touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # numbers below the number of buckets
        if not touched:
            return 0
        with self._alone():
            whole = self.spark.read.parquet(f"{self.path}/data")
            old = whole.filter(F.col(BUCKET).isin(*touched)).drop(BUCKET)
            staged = f"{self.path}/staged-{uuid.uuid4().hex}"
            self._dealt(merged(old)).write.parquet(staged)
            done = self.spark.read.schema(whole.schema).parquet(staged)
            done.repartition(F.col(BUCKET)).write.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).mode("overwrite").parquet(f"{self.path}/data")
            self._files(staged)[0].delete(self._files(staged)[1], True)
        return len(touched)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @contextmanager
    def _alone(self) -> Iterator[None]:
        fs, lock = self._files(f"{self.path}/_lock")
        try:
            fs.create(lock, False).close()  # of two writers the file system lets one create it
        except Exception as e:
            raise Busy(f"{self.path}: {lock} is there; a writer that was killed leaves it, unlock() takes it away") from e
        try:
            yield
        finally:
            fs.delete(lock, False)

    def unlock(self) -> None:
        fs, lock = self._files(f"{self.path}/_lock")
        fs.delete(lock, False)
