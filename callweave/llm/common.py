"""What several of the operators share: table access, text columns, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import graph


#: The words of all contracts: maximal runs outside of space and \\t..\\r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows for this session: texts are long, and batches make most of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and ``text`` as UTF-8 bytes (null: empty), so that Python workers need not decode; in small batches."""
    small_batches(df.sparkSession)
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of a column as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as it takes to differ from all columns, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)``, root the smallest node reachable."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("node"), "root")
