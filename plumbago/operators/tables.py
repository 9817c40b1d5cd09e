"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Where that is unset, a local folder serves a local master, as
    in tests; on a cluster that is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.plumbago.folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbago-")
        spark.conf.set("spark.plumbago.folder", base)
    return f"{base.rstrip('/')}/plumbago-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str = "round") -> DataFrame:
    """Write df once and read it back: lineage ends here, so a lost executor never re-runs what came before."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it once the results that rest on them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, before clean()."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with a number from 0 in the given order. They are sorted over all tasks and stored; a row adds its place in
    its part to the rows of the parts before, of which there are as many as shuffle partitions."""
    placed = stored(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33).cast("int")
    before, total = [], 0
    for k, n in sorted((r["_part"], r["n"]) for r in placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()):
        before.append((k, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(before, "_part int, _before long")
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_before", "_place")
