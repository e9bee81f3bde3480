"""Reading tables and identifying rows."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns: Column) -> list[Column]:
    """Two columns that tell rows apart by content; rows that agree in all are alike.

    A join on both is safe against repeated and null ids: rows with equal keys have
    equal results.
    """
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(7), *columns).alias("_k2")]


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


#: Bits for each wanted key in the bitmap of ``perhaps_in``, and the most bits (32 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 28


def perhaps_in(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose key (hashed, not null) is among the ``n`` wanted ones, and a few others.

    A bitmap of the keys' last bits is broadcast, two to four bytes a key. Up to 16 million keys
    at most one in 16 of the other rows passes; an exact join has to follow.
    """
    bits = min(MOST_BITS, 1 << max(15, (BITS_PER_KEY * n - 1).bit_length()))
    at = F.pmod(F.col(key), F.lit(bits)) + 1  # bucket numbers and positions count from one
    maps = wanted.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    isset = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(at) == F.col("_bucket")) & isset, "left_semi")


def bound_batches(spark: SparkSession, mb: int = 16) -> None:
    """Hand rows to Python in batches of a bounded size, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session may do with a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="wattlane-tables-")
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a folder and read it again, planned by the size that it has.

    A checkpoint keeps the size that the optimizer guessed, and a join's guess is the product of its
    sides'. In a loop that joins its own results the guess doubles its digits each time, until the driver
    is busy with nothing else and full of them.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored_at`` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a table in the shared folder, without the constraints of its plan.

    A checkpoint keeps what the optimizer knows about its columns; in loops these facts
    pile up and planning takes longer each time.
    """
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return session.cut_lineage(df)
    finally:
        conf.set(key, before)
