"""What the operators of this folder share: reading tables, written intermediate tables, batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts are long, so the batches are kept short.
ARROW_ROWS, ARROW_BYTES = "1000", str(32 << 20)
#: Bits of a membership filter: 8 MB.
FILTER_BITS = 1 << 26
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads a table of the input folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session, as in tests, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sitelens-"))
        folder = _own[0]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that no result reads any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            jvm = t.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names like the given ones that no column of df bears, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def maybe_in(df: DataFrame, key: str, ids: DataFrame, flag: str = "_maybe") -> DataFrame:
    """df with the boolean flag: false only where the bigint column key equals no id of ids (one column, ``id``).

    The identifiers' hashes set bits of a map of FILTER_BITS bits, cut into rows of 4 kB, so at most FILTER_BITS / 8 bytes
    are broadcast however many there are; beyond a few per FILTER_BITS more rows are marked than need be, none is missed.
    """
    row, at_byte, at_bit, map_ = free(df, "_bits_row", "_bits_byte", "_bits_bit", "_bits")
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(41)), F.lit(FILTER_BITS))
    bits = ids.select(place.alias("_p")).groupBy(F.shiftright("_p", 15).alias(row)).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(F.lit(32767))).alias(map_))
    own = F.pmod(F.xxhash64(F.col(key), F.lit(41)), F.lit(FILTER_BITS))
    at = own.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.expr(f"substring({map_}, cast({at_byte} AS int) + 1, 1)")), 16, 10).cast("int")
    marked = df.withColumn(row, F.shiftright(own, 15)).withColumn(at_byte, F.shiftright(at, 3)).withColumn(at_bit, at.bitwiseAND(F.lit(7)).cast("int"))
    marked = marked.join(F.broadcast(bits), row, "left")  # FILTER_BITS / 8 bytes at most
    bit = F.coalesce(byte, F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col(at_bit)))
    return marked.withColumn(flag, bit != 0).select(*columns_of(df), flag)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose bigint column key is null or equals no id of ids. Only rows that may equal one are exchanged."""
    flag, gone = free(df, "_maybe", "_gone")
    marked = maybe_in(df, key, ids, flag)
    open_ = marked.filter(F.col(flag)).drop(flag).join(ids.select(F.col("id").alias(gone)), F.col(key) == F.col(gone), "left_anti")
    return marked.filter(~F.col(flag)).drop(flag).unionByName(open_)
