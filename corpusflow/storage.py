"""Tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset, a local session names a temporary folder of this
    machine once; on a cluster, whose executors could not read that, it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusflow-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cf-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusflow_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more, and let the driver give back the memory of plans that are done."""
    some = False
    for df in frames:
        path = getattr(df, "_corpusflow_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            some = True
    if some:
        del target
        let_go(df)


def let_go(df: DataFrame) -> None:
    """Have the driver give back the memory of plans that are done, and with it what they shuffled, which stays on disk until then."""
    jvm = df.sparkSession._jvm
    del df
    gc.collect()
    jvm.System.gc()
