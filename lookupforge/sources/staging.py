"""Tables written between the parts of a long plan: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only a session of one local process gets a temporary
    one where none is named; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        made = sc._jsc.sc().getCheckpointDir()
        if not made.isDefined():
            if not sc.isLocal:
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            made = sc._jsc.sc().getCheckpointDir()
        named = made.get()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
