"""Tables of the library's own in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; only a local session, as in tests, gets one of its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lithograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, below one folder for each application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, so that what follows neither computes it again nor depends on its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files have fewer parts than there are cores; a large table has more, and stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def release(df: DataFrame) -> None:
    """Deletes a table that saved() has written and that no result still to be computed reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def split_join(big: DataFrame, small: DataFrame, on: str, by: str, share: int = 4, least: int = 500) -> DataFrame:
    """big joined with small on a column; values that fill more than 1 / (share * partitions) of big are dealt to several tasks.

    Rows of such a value in big go by the hash of `by`, and its rows in small to each of the parts. How many values
    that are is bounded by the number of partitions.
    """
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = big.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > least) & F.col(on).isNotNull())
    frequent = counts.orderBy(F.desc("n")).limit(share * partitions).collect()
    total = big.count() if frequent else 0
    limit = max(least, total // (share * partitions))
    hot = [(r[on], -(-r["n"] // limit)) for r in frequent if r["n"] > limit]
    if not hot:
        return big.join(small, on)
    listed = F.broadcast(big.sparkSession.createDataFrame(hot, f"`{on}` {big.schema[on].dataType.simpleString()}, __parts int"))
    dealt = big.join(listed, on, "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copied = small.join(listed, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [on, "__part"]).drop("__part")
