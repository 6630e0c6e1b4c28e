"""Shared folder of the cluster, small files in it that only one writer can make, and connected components."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where the setting is absent a temporary one becomes it on one machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(base := tempfile.mkdtemp(prefix="plotmere-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, whole and once: False where it is there already. Of several writers one succeeds.

    It is written aside first, then linked (local files) or renamed (stores whose rename does not replace) to its name.
    """
    fs, at = _file_system(spark, path)
    fs.mkdirs(at.getParent())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        local = lambda p: unquote(urlparse(p.toUri().toString()).path)
        try:
            os.link(local(aside), local(at))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)
    done = not fs.exists(at) and fs.rename(aside, at)
    if not done:
        fs.delete(aside, False)
    return done


def read_file(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, in order; none where it is absent."""
    fs, at = _file_system(spark, folder)
    return sorted(str(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df over all tasks: a small file is read by one, however much is made of each of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for links a, b (longs): the least node of what each is linked to.

    Alternates two steps until nothing changes: every node hands the least of its neighbours to its larger ones, then to
    its smaller ones. A step is an aggregation (combined before the shuffle) and a join back. Each round is written to the
    shared folder, with a count and a sum of hashes that tell whether it changed anything.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession, "components")
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{folder}/0")
    last = None
    for number in itertools.count(1):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        up = both.filter("b > a").hint("merge").join(low, "a").select(F.col("low").alias("a"), "b").distinct()
        least = up.groupBy("b").agg(F.min("a").alias("low"))
        down = up.hint("merge").join(least, "b").select(F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("b").alias("y")), F.struct(F.col("low").alias("x"), F.col("a").alias("y")))).alias("l"))
        links = written(down.filter("l.x < l.y").select(F.col("l.x").alias("a"), F.col("l.y").alias("b")).distinct(), f"{folder}/{number}")
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            roots = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
        last = state
