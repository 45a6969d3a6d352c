"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = 2**63 - 1
#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound is a number of rows, however long their texts are.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, where the user has not; a longer text is a batch of its own."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set (tests)."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="proofgrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{folder(spark)}/proofgrid/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.proofgrid_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() made and nothing reads any longer, and the shuffle files behind them."""
    for df in tables:
        path = getattr(df, "proofgrid_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does so when the driver collects what refers to them, which
    a driver with memory to spare puts off."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of the filter of may_be_in; as words of 64 bits it has FILTER_BITS / 64 rows at most, so its broadcast does not grow with the data.
FILTER_BITS = 1 << 22


def may_be_in(rows: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns may be among keys, the others): both of rows' own columns; the first holds every row that a join with keys would
    find, and few others until keys are about as many as FILTER_BITS. It keeps rows that a join can't find out of that join's shuffle,
    texts and all. keys has the same columns and is written already. A null key is never found."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    words = keys.groupBy(F.shiftright(slot, 6).alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64({', '.join(columns)}), 64) as int)))").alias("__bits"))
    own = rows.withColumn("__slot", slot)
    seen = own.join(F.broadcast(words), F.shiftright(own["__slot"], 6) == words["__word"], "left").withColumn("__may", F.coalesce(F.expr("shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1L"), F.lit(0)) == 1)
    return tuple(seen.filter(f).drop("__slot", "__word", "__bits", "__may") for f in (F.col("__may"), ~F.col("__may")))


def renamed(df: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ... but for own, which keep their names, and its names before: no name of ours can clash with the user's."""
    return df.toDF(*[n if n in own else f"c{i}" for i, n in enumerate(df.columns)]), df.columns


#: A side of a join whose size follows its data is broadcast up to so many bytes; beyond them both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where its values, counted in bytes first, are few enough. df is written already."""
    wide = [F.octet_length(F.col(n)) if t in ("string", "binary") else F.lit(8) for n, t in df.dtypes]
    size = df.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(column: str = "doc_id") -> Column:
    """A null id sorts after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID)).alias("k1")


def text_key(column: str = "text") -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("k2")
