"""Tables that cut lineage: written to the folder that the driver and all executors share, so an executor's loss takes nothing away."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where a session of one machine names none, as in tests, a new temporary folder; elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[Column], name: str, **most: Column) -> tuple[DataFrame, int, dict]:
    """``df``, written in the order of ``by`` with ``row`` from 0 on, its rows' number, and the greatest values of ``most``.

    Ranges are sorted each by itself and counted, so no task numbers all rows; rows that ``by`` does not tell apart are numbered all the same.
    """
    at = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.monotonically_increasing_id()), name)
    part = F.shiftright("__p", 33)
    before, rows, found = [], 0, dict.fromkeys(most)
    for r in at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), *(F.max(c).alias(k) for k, c in most.items())).orderBy("__part").collect():  # a row a range
        before.append((r["__part"], rows))
        rows += r["__n"]
        found = {k: r[k] if v is None else v if r[k] is None else max(v, r[k]) for k, v in found.items()}
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __before long"))
    at = at.withColumn("__part", part.cast("long")).join(starts, "__part")
    return at.withColumn("row", F.col("__before") + F.col("__p").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__part", "__before"), rows, found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts in a store that ``replaced`` keeps; None if nothing was written yet."""
    try:
        return f"{path}/{spark.read.text(f'{path}/current', wholetext=True).first()[0]}"
    except Exception as e:  # Spark says so only when it lists the files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _point(spark: SparkSession, path: str, version: str) -> str:
    """Writes a new file that names a version, beside the one that counts."""
    context = spark.sparkContext
    at = f"{path}/next-{version}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(at)
    out = hadoop.getFileSystem(context._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(version.encode()))
    out.close()
    return at


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts a file in the place of another in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, f"{path}/current"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf).rename(source, target, options)


def _clean(spark: SparkSession, path: str, kept: tuple[str, ...]) -> None:
    """Deletes versions, and files that name them, but for those kept."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name != "current" and name not in kept:
            fs.delete(status.getPath(), True)


def replaced(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> str:
    """Writes ``df`` as the version of a store that counts from now on, in folders ``by`` columns, and returns its folder; ``df`` may read the store itself.

    A version is a folder of its own, and one file names the one that counts; that file is replaced in one step after the
    version is complete. So whatever fails, and whenever, readers find all of the old rows or all of the new ones. The version
    before stays for those that read it still; older ones, and what failed writes left, are deleted. One writer at a time.
    """
    spark, old, version = df.sparkSession, current(df.sparkSession, path), f"v-{uuid.uuid4().hex}"
    out = df.write.format(form)
    (out.partitionBy(*by) if by else out).save(f"{path}/{version}")
    _swap(spark, _point(spark, path, version), path)
    _clean(spark, path, (version, old.rsplit("/", 1)[1] if old else version))
    return f"{path}/{version}"
