"""Where results of a plan are kept, and how small inputs are dealt."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Partitions a core below which a table counts as small.
FEW = 4


def with_folder(spark: SparkSession) -> SparkSession:
    """Sees to a checkpoint folder. The cluster names it in spark.checkpoint.dir; a folder of one's own is made in local
    mode alone, as other machines would not see it."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilspark-"))
    return spark


def once(df: DataFrame) -> DataFrame:
    """Checkpoints df, so that several branches of a plan read what was computed once."""
    with_folder(df.sparkSession)
    return df.checkpoint()


def dealt(scan: DataFrame) -> DataFrame:
    """A table as it was read, dealt over all cores if its files have few parts, so that kernels don't wait for one
    task; a table of many parts is left as it is and isn't shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < FEW * cores else scan
