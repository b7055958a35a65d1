"""Intermediate tables in the folder that driver and executors share, and checked broadcasts."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join may be broadcast, by its rows' own sizes.
BROADCAST_BYTES = 16 << 20
#: What a row takes beside its values.
_ROW_BYTES = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` as the session has it. Only where that is unset and everything runs on one
    machine, as in tests, a temporary folder is made and set; on a cluster it has to be given.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate Parquet tables in the shared folder.

    A written table cuts lineage, survives the loss of any executor, and holds narrow columns only. ``drop``
    removes tables that no later step reads; whatever is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(tag))
        return self.load(tag, df.schema)

    def load(self, tag: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(tag))

    def observed(self, df: DataFrame, tag: str, *aggs: Column) -> tuple[DataFrame, dict]:
        """``df`` as a saved table with a known size, and aggregates of its rows, all from one job."""
        seen = Observation()
        fixed, varying = _width(df.schema)
        saved = self.save(df.observe(seen, F.count(F.lit(1)).alias("_n"), _varying_bytes(varying).alias("_size"), *aggs), tag)
        got = seen.get
        return known_size(saved, got["_n"], got["_n"] * fixed + got["_size"]), got

    def sized(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` as a saved table whose rows and bytes ``size_of`` and ``small_side`` know without reading it again."""
        return self.observed(df, tag)[0]

    def small(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` as a saved table, marked for broadcast if it is small: it is computed once, not again to be counted."""
        return small_side(self.sized(df, tag))

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(tag)), True)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of what has ended: it does so once the driver has collected its garbage.

        Listeners hold what has ended until they were told of it, and the JVM learns late what Python has let go of, so
        once is not always enough.
        """
        for pause in (0.2, 0.0):
            gc.collect()
            with contextlib.suppress(Py4JError):  # listeners may be late
                self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(pause)


def _width(schema: T.StructType) -> tuple[int, list]:
    """Bytes of a row's fixed part, and expressions for the bytes of what varies."""
    fixed, varying = _ROW_BYTES + 8 * len(schema), []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            varying.append(F.octet_length(c))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            varying.append(8 * F.size(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            varying.append(F.octet_length(F.to_json(F.struct(c))))
    return fixed, varying


def _varying_bytes(varying: list) -> Column:
    """Bytes of all rows, but for their fixed parts."""
    each = sum((F.coalesce(v, F.lit(0)) for v in varying), F.lit(0)).cast("long")
    return F.coalesce(F.sum(each), F.lit(0).cast("long"))


def known_size(df: DataFrame, rows: int, size: int) -> DataFrame:
    """``df`` with the number of its rows and their bytes."""
    df.__dict__["_known"] = (rows, size)
    return df


def size_of(df: DataFrame) -> tuple[int, int] | None:
    """Rows and bytes of a table as ``sized`` has saved it; None for all others."""
    return df.__dict__.get("_known")


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows have at most ``limit`` bytes together, else as it is: the join then shuffles.

    A table with a known size is not counted, nor is one with the rows of such a table ``of``. Of others, no more rows are
    counted than can fit, so the count is cheap however large the side is.
    """
    known = size_of(df if of is None else of)
    if known:
        return F.broadcast(df) if known[1] <= limit else df
    fixed, varying = _width(df.schema)
    most = limit // fixed + 1
    rows = df.limit(most)
    if not varying:
        return F.broadcast(df) if rows.count() < most else df
    n, size = rows.agg(F.count(F.lit(1)), _varying_bytes(varying)).first()
    return F.broadcast(df) if n < most and n * fixed + size <= limit else df
