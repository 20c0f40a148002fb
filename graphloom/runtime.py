"""Checkpoints and tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; on one machine, where none is named, a temporary one."""
    named = spark.conf.get(FOLDER, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {FOLDER} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(FOLDER, folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder as Parquet and read again: for large frames, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """The frame, stored, with ``name``: the numbers from 0, by partition and by place in it.

    Each row is stored with both, and counts of rows before each partition, as
    many as there are partitions, are a constant of the plan.
    """
    rows = stored(df.withColumn("__m", F.monotonically_increasing_id()))
    part, row = F.shiftright("__m", 33).cast("int"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in before]), part + 1) if before else F.lit(0)
    return rows.withColumn(name, (start + row).cast("bigint")).drop("__m")


#: Rows of a partition where their number is known.
ROWS = 250_000


def partitions(spark: SparkSession, rows: int = 0) -> int:
    """As many as the session has, or more, so that a task's memory does not grow with so many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS + 1)


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """The frame by keys, in as many partitions as the session has or ``rows`` need.

    A number that is given is not lowered: rows that compress well would else be
    merged by their compressed size into partitions that fill a task's memory.
    """
    return df.repartition(partitions(df.sparkSession, rows), *keys)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a location on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
