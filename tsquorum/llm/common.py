"""Shared plumbing: lineage cuts in the cluster's shared folder, and distributed prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators, as a Java/RE2 character class: space, tab, newline, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"

#: A key with more than one in so many of all rows is hot; so there are at most as many hot keys.
HOT = 10_000
#: Salts of a side that every row's key is looked up in.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all runs on one machine, as in tests, a temporary folder takes its place;
    it goes when the process ends. On a cluster the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tsquorum-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tsquorum/{kind}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


class Cuts:
    """Tables written to the shared folder to cut lineage; a lost executor re-reads, not recomputes.

    ``cut`` writes and re-reads a DataFrame, compressed as Parquet is by default or by ``codec``. ``drop`` deletes the tables that nothing needs any more.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path, compression=codec)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all(self, but: str) -> None:
        """Deletes all tables but those named ``but``."""
        for name in [n for n in self.paths if n != but]:
            self.drop(name)

    def drop(self, name: str, keep_last: bool = False) -> None:
        paths = self.paths.get(name, [])
        for path in paths[:-1] if keep_last else paths:
            _remove(self.spark, path)
        self.paths[name] = paths[-1:] if keep_last else []


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, after which the worker gives unused memory back; idle workers stay small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_draw(*parts: Column) -> Column:
    """A reproducible draw in [0, 1) from the parts' text, equal in any engine that has MD5."""
    key = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def let(expr: Column, body) -> Column:
    """Binds ``expr`` once for ``body``, which may use it many times, also inside lambdas."""
    return F.transform(F.array(expr), body)[0]


def join_spread(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``side``, one row per ``key`` (nulls are equal), where few keys may hold most rows.

    The side is repeated for ``SALTS`` salts, so no key's rows meet in one task; a side small enough to be broadcast
    (by the session's threshold, from the sizes of its files) is, and then nothing is shuffled.
    """
    salted = side.withColumnRenamed(key, "_spread_key").withColumn("_spread_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_spread_salt_of", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col(key).eqNullSafe(F.col("_spread_key")) & (F.col("_spread_salt_of") == F.col("_spread_salt")), "left").drop("_spread_key", "_spread_salt", "_spread_salt_of")


def join_hot(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``side``, which has one row per ``key`` and in ``n`` the number of rows with it.

    Keys with more than ``total / HOT`` of the ``total`` rows are split into parts of that size. They are at most
    ``HOT`` and are broadcast with their number of parts; the side is repeated by part, at most ``2 * HOT`` times in all.
    """
    hot = F.broadcast(side.where(F.col(n) * HOT > total).select(key, F.ceil(F.col(n) * F.lit(HOT) / F.lit(max(1, total))).cast("int").alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    parts = side.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts", n)
    return dealt.hint("merge").join(parts, [key, "_part"]).drop("_part")


def chunks_for(n: int) -> int:
    """Chunks for ``ranked`` of ``n`` rows: enough that a chunk of one key stays small."""
    return max(256, n // 100_000)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, chunks: int = 256, by: list[str] | None = None) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within ``keys``, without gathering a key in one task.

    Rows of a key are spread over ``chunks`` by a hash of ``by`` (default ``order``); chunks are counted,
    the counts summed up per key (at most ``chunks`` rows each), and rows numbered within their chunk.
    """
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*(by or order)), F.lit(chunks)).cast("int"))
    counts = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inner) - 1)
    return numbered.join(starts, [*keys, "_chunk"]).withColumn(name, (F.col("_start") + F.col("_rn")).cast("long")).drop("_chunk", "_start", "_rn")
