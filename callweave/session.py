"""Session defaults and the two ways this library cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "callweave", **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; ``conf`` adds or overrides settings."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine, as in tests, a temporary folder is made and
    set. On a cluster such a folder would be another one on every machine, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="callweave-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Later reads survive the loss of any executor, and random ids made upstream stay as written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/callweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables whose last reader has been written; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            df._written_to = None


class Rounds:
    """The rows of a loop's rounds, each written once; ``all`` reads what there is so far."""

    def __init__(self, *first: DataFrame):
        self.tables: list[DataFrame] = []
        for df in first:
            self.add(df)

    def add(self, df: DataFrame) -> DataFrame:
        self.tables.append(materialize(df))
        return self.tables[-1]

    def all(self) -> DataFrame:
        last = self.tables[-1]
        return last.sparkSession.read.schema(last.schema).parquet(*(t._written_to for t in self.tables))
